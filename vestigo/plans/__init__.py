"""Registered queries over the test tables, each with the SQL it must agree with where SQL can say it."""

from vestigo.plans import media, text, vectors

QUERIES = {**text.QUERIES, **vectors.QUERIES, **media.QUERIES}
SQL = {**text.SQL, **vectors.SQL, **media.SQL}
