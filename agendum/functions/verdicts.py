"""Verdicts on what a row says of itself: news that are no events, and names that are no organisers.

A sign is a list of slots: sets of word stems that must come one after another in one sentence, a few words apart at most. Signs
are data, so callers may bring their own; those here are for folded French, Italian and English.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from agendum.functions.text import fold, let

#: Between two words of a sentence, and a word in folded text.
GAP, LETTERS = r"[^\p{L}\p{N}.!?;]+", r"[\p{L}\p{N}]"


@dataclass(frozen=True)
class Sign:
    """The reason that stems in this order give; a slot is its stems separated by blanks, a stem with a dot is a whole word."""

    reason: str
    slots: tuple[str, ...]
    apart: int = 3

    def pattern(self) -> str:
        """A regular expression for folded text; it holds no look-around, so that other engines read it too."""
        stem = lambda s: s[:-1] if s.endswith(".") else s + LETTERS + "*"
        words = ["(?:" + "|".join(stem(s) for s in slot.split()) + ")" for slot in self.slots]
        between = rf"(?:{GAP}{LETTERS}+){{0,{self.apart}}}{GAP}"
        return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{between.join(words)})(?:[^\p{{L}}\p{{N}}]|$)"


#: What is told and not announced: how to get somewhere, disturbed roads, decisions of a council, warnings, accidents,
#: inquiries, results, and looks back.
NON_EVENT = [
    Sign("access", ("comment ou. how. where. come. dove.", "parqu gare. garer. stationn acced park. parcheg arriv"), 2),
    Sign("roads", ("circul route. routes. chausse voie. trafic. strada strade traffico viabilita. road. traffic.", "perturb coupe ferm devi interdi chius interrott closed. blocked.")),
    Sign("roads", ("fermeture chiusura deviation travaux. lavori. closure.", "route. routes. rue. voie. pont. strada strade via. ponte. road.")),
    Sign("decision", ("conseil elus. conseill consiglio giunta council.", "vot adopt deliber approuv approv budget. bilancio."), 6),
    Sign("warning", ("vigilance. alerte. allerta. warning.", "meteo. orage canicul neige. vent. crue jaune. rouge. orange. temporal neve. vento. rossa. gialla. storm."), 4),
    Sign("accident", ("incend feu. flammes. accident. avalanche. rogo. valanga. fire.", "ravag detrui bless endommag distru ferit destroy injur"), 5),
    Sign("inquiry", ("enquete. concertation. consultation. inchiesta. consultazione.", "publi pubbli citoyen"), 1),
    Sign("result", ("remport gagn sacre vainqueu vince. vinto. trionf wins. won.", "tournoi. championnat. coupe. match. finale. titre. torneo. campionato. coppa. partita. cup. title."), 4),
    Sign("look back", ("retour. bilan. souvenir succes. ritorno. bilancio. successo. look.", "edition. annee. saison. soiree. edizione. anno. serata. back."), 5),
]
#: Words that date a text by the day it was written, as stems and slots like those of signs.
FLEETING = [
    Sign("day", ("hier. aujourd demain. ieri. oggi. domani. stasera. stamattina. yesterday. today. tomorrow. tonight.",)),
    Sign("near", ("ce. cet. cette. ces. questo. questa. this. next. last. prossim scors", "soir. matin. weekend. week. semaine. jours. settimana. mattina. sera. weekend. morning."), 0),
    Sign("near", ("semaine. settimana. lundi. mardi. mercredi. jeudi. vendredi. samedi. dimanche. lunedi. martedi. sabato. domenica.", "prochain. prochaine. dernier. derniere. prossim scors"), 0),
]
#: Stems of words that name a body, and names of accounts that publish for others.
BODIES = "associa comit mairie. comun office. uffici mus theatr teatr club. loco. fonda compagn orchestr cinem biblio mediathe syndic festiv ville. citta. ecole. scuol librair librer galeri galler amis. amici. societ union"
ACCOUNTS = "redac redaz admin webmaster. communication. comunicazione. presse. stampa. wordpress. anonym anonim editor. staff."
#: What makes the name behind it an organiser: an act and its agent, or an office held.
ACTS = "organis organizz propos anim mont curat prepar realis realizz port"
AGENTS = "par. da. dal. dalla. di. by."
OFFICES = "organisat organizzat president direct responsab animat coordinat"


def _any(stems: str) -> str:
    return "(?:" + "|".join(s[:-1] if s.endswith(".") else s + LETTERS + "*" for s in stems.split()) + ")"


def sign_reason(text: Column, signs: list[Sign], together: int = 6) -> Column:
    """The reason of the first of the signs that the text holds; null for none. Most texts hold no sign, so some signs together are
    looked for in one pass, and one by one only where any of them stands."""
    edge = Sign("", ()).pattern().split("(?:)")
    any_of = lambda some: edge[0] + "(?:" + "|".join(s.pattern().removeprefix(edge[0]).removesuffix(edge[1]) for s in some) + ")" + edge[1]
    groups = [signs[n : n + together] for n in range(0, len(signs), together)]
    first = lambda t, some: F.coalesce(*[F.when(t.rlike(s.pattern()), F.lit(s.reason)) for s in some])
    return let(fold(text), lambda t: F.coalesce(*[F.when(t.rlike(any_of(some)), first(t, some)) if len(some) > 1 else first(t, some) for some in groups]))


def non_event_reason(title: Column, description: Column, signs: list[Sign] | None = None) -> Column:
    """Why a row is news and no event; null where nothing says so."""
    return sign_reason(F.concat_ws(". ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))), signs or NON_EVENT)


def person_name(name: Column) -> Column:
    """Whether a name has the form of a person's: two or three words with capitals besides short words without (particles), no
    word for a body, no digits or signs of addresses, 60 characters at most."""
    words = F.filter(F.split(F.trim(name), r"[\s-]+"), lambda w: (w != "") & ~((F.length(w) <= 5) & w.rlike(r"^\p{Ll}")))
    plain = (F.length(F.trim(name)) <= 60) & ~name.rlike(r"[\p{N}@/|:;\n]")
    return plain & F.size(words).between(2, 3) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}") & ~fold(w).rlike(f"^{_any(BODIES)}$"))


def corroborated(name: Column, material: Column) -> Column:
    """Whether a sentence of the material says in the twelve words before the name that it organises: an act with its agent, or an office."""
    flat = lambda c: F.regexp_replace(fold(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    proof = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{_any(ACTS)}(?:{GAP}{LETTERS}+){{0,2}}{GAP}{_any(AGENTS)}|{_any(OFFICES)})(?:{GAP}{LETTERS}+){{0,9}}(?:{GAP})?"
    # Folded names hold no \\E. The name is part of the pattern, as its places may overlap: "par Par Par".
    told = lambda s: F.left(s["m"], F.length(s["m"]) - F.length(F.call_function("substring_index", s["m"], s["n"], F.lit(-1))))  # noqa: E731  up to the name's last place
    sides = let(F.struct(flat(name).alias("n"), flat(material).alias("m")), lambda s: F.struct(s["n"].alias("n"), told(s).alias("m")))
    return let(sides, lambda s: (s["m"] != "") & F.regexp_like(s["m"], F.concat(F.lit(proof + "\\Q"), s["n"], F.lit("\\E"))))


def byline_verdict(name: Column, material: Column) -> Column:
    """What to do with an organiser: empty, account (drop), body (keep), corroborated (keep) or person (drop: a name without proof)."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    account = fold(bare).rlike(rf"^(?:{_any('service. ufficio. la. il. le.')} )?{_any(ACCOUNTS)}$")
    return F.when(bare == "", "empty").when(account, "account").when(~person_name(bare), "body").when(corroborated(bare, material), "corroborated").otherwise("person")


def perishable(text: Column, signs: list[Sign] | None = None) -> Column:
    """The words by which a text dates itself, folded, in order of the signs and without repeats."""
    inner = [s.pattern().removeprefix(r"(?:^|[^\p{L}\p{N}])").removesuffix(r"(?:[^\p{L}\p{N}]|$)") for s in signs or FLEETING]
    found = let(fold(text), lambda t: F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{p})(?![\p{{L}}\p{{N}}])"), 0) for p in inner])))
    return F.array_distinct(found)
