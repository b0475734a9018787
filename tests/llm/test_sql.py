"""Every query of the subpackage that has SQL against it, on the smallest tables."""

import glob
import math

import duckdb
import pytest

from vecloom.llm.registry import ORACLE_SQL, QUERIES


def clean(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["pii_counts", "ann_recall", "mixing_targets", "packing_whole", "op1_html", "op3_exact_dedup", "op9_chat"])
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {path.split('/')[-1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df, cursor = QUERIES[name](spark, sf_dir), db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert clean([tuple(r) for r in df.collect()], df.columns) == clean(cursor.fetchall(), names)
