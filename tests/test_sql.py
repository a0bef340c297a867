"""Registered queries against their SQL on small tables whose rows are hard for one of the two."""

import duckdb

from docquarry.plans.registry import ORACLES, QUERIES


def differences(spark, folder, name, tables):
    """Rows that only the query has, and rows that only its SQL has."""
    with duckdb.connect() as db:
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        found = db.execute(ORACLES[name])
        columns, want = [c[0] for c in found.description], found.fetchall()
    got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(folder)).collect()]
    assert want
    return [r for r in got if got.count(r) > want.count(r)], [r for r in want if want.count(r) > got.count(r)]


def test_probe_cache_scores_near_a_rounding_border(spark, tmp_path):
    texts = [
        "Ndoust tionor a. Onha ndly thbleou shenou and that it of in lytire. Er. A ertioner a en erouhe stsh ndou ertilyly, eahe ly of anenre hahe heing re, "
        "thndheth to inthwheati anor atinsh, erst the the enhaat orre tiing erouat thedat thsthe thin the thlylyre eredthha atrend thtitionou onhe, eaenon ed "
        "thanou inonon shsh theatiha ananen.",
        "Airéque éoument quetre êouai leaiieraiier leque éeauoich la elleelle enparé, mentier euxauxaux des.",
        "Erch stch ststtz undschstachber enberteach die als der das ist berst schö tezu.",
        "Treeaué éé ierêch reené, aienvi èaich ou airé, oiaimentèeux aiier.",
    ]
    turns = [(i, 0, "user", t) for i, t in enumerate(texts)] + [(9, 0, "assistant", "unlike"), (9, 1, "user", ""), (9, 2, "assistant", None)]
    assert differences(spark, tmp_path, "probe_cache", {"conversations": (turns, "conv_id long, turn long, role string, text string")}) == ([], [])


def test_chunk_markdown_of_odd_documents(spark, tmp_path):
    rows = [(1, "Ñ Ñ Ñ.", "es", "src1"), (2, "", "en", "src1"), (3, None, "en", "src2"), (4, "abc", None, "src2"), (5, "abc", "en", None), (6, "a Word.", "en", "src17"), (-9, None, None, None), (None, "ok", "de", "src1")]
    assert differences(spark, tmp_path, "chunk_markdown", {"documents": (rows, "doc_id long, text string, lang string, source string")}) == ([], [])
