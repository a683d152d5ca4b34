"""The registry of queries over the test tables and their SQL."""

from agendum.plans import editorial, jobs, relational, streams, texts, verdicts, worklists

QUERIES = {**relational.QUERIES, **texts.QUERIES, **jobs.QUERIES, **editorial.QUERIES, **streams.QUERIES, **worklists.QUERIES, **verdicts.QUERIES}
SQL = {**relational.SQL, **texts.SQL, **jobs.SQL, **editorial.SQL, **streams.SQL, **worklists.SQL, **verdicts.SQL}
