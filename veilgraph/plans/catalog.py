"""Every query by name, and the SQL that gives the same rows."""

from . import disclosure, people, texts

QUERIES = {**disclosure.QUERIES, **texts.QUERIES, **people.QUERIES}
ORACLE_SQL = {**disclosure.ORACLE_SQL, **texts.ORACLE_SQL, **people.ORACLE_SQL}
