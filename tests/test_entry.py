import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import queries as core

TABLES = "documents document_entities entities canonical_entities entity_aliases email_metadata thread_messages mail_domains mix_targets review_labels".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def rows(cursor_rows):
    clean = lambda v: round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, list) else v
    return sorted((tuple(clean(v) for v in r) for r in cursor_rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = c.execute(core.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    got = rows(df.select(*cols).collect())
    assert got == rows(tuple(r[names.index(k)] for k in cols) for r in want.fetchall())
