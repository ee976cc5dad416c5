"""The pipeline's stages against plain Python, and the registry."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from velaspan.llm import registry

P = pytest.importorskip("public_tokenizers")


def rows():
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ka", "to", "mi", "ru", "sa"]) for _ in range(r.randint(1, 3)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage = say(60)
    out = [(i, say(80)) for i in range(40)]
    out += [(40 + i, out[i][1]) for i in range(8)]  # exact copies
    near = out[9][1].split()
    near[40] = "other"
    out += [(50, " ".join(near))]
    out += [(60, say(30) + "\n" + passage + " " + say(20)), (61, passage), (62, say(25) + " " + passage)]
    out += [(70, say(20) + ' token = "8b540ef2c226668020056c2469c653445539f8d7" ' + say(5)), (71, None), (72, ""), (73, "12 34 !!"), (74, "ka")]
    # copies of a text that near-dedup leaves, as a whole inside a longer one
    return out


def frame(spark, values):
    return spark.createDataFrame([(i, t, "aa", "s", len(t or ""), "x", 1.0) for i, t in values], "doc_id long, text string, lang string, source string, n_chars long, _spans string, score double").repartition(3)


def test_stages(spark):
    docs = frame(spark, rows())
    columns = docs.columns
    kept = docs
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema], name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    source = dict(rows())
    assert set(seen["language"]) == set(source) - {71, 72, 73}
    assert set(source) - {71, 72, 73} - set(seen["near_dedup"]) == {*range(40, 48), 50}
    cut = seen["substring_dedup"]
    assert 61 not in cut and set(seen["near_dedup"]) - set(cut) == {61}
    passage = source[61]
    assert cut[60] == source[60].replace(passage + " ", "") and cut[62] == source[62].replace(passage, "")
    assert all(cut[k] == source[k] for k in cut if k not in (60, 62))
    safe = seen["secret_scan"]
    assert "[SECRET]" in safe[70] and "8b540" not in safe[70] and all(safe[k] == cut[k] for k in cut if k != 70)
    pieces = pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert {r["doc_id"] for r in pieces} == set(safe) and max(r["length"] for r in pieces) <= 4096


def test_one_row_of_each_group_stays(spark):
    texts = dict(rows())
    own = {i: texts[i] for i in range(6)}
    near = own[3].split()
    near[40] = "other"
    lone = texts[20], texts[21]
    # repeated rows; copies, whole and near, without an id; texts that only rows without an id have, one of them twice; one id with two texts
    values = [*own.items(), (0, own[0]), (0, own[0]), (1, own[1]), (None, own[2]), (None, " ".join(near)), (None, lone[0]), (None, lone[0]), (None, lone[1]), (4, texts[22]), (7, own[5])]
    want = sorted([*own.items(), (None, lone[0]), (None, lone[1]), (4, texts[22])], key=repr)
    kept = frame(spark, values)
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        if name != "language":
            assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == want, name


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_empty_tables(spark, stage):
    docs = frame(spark, rows()).limit(0)
    assert stage(spark, docs, "").count() == 0


def test_run_on_the_tables(spark, data):
    got = pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    assert 0 < len(ids) <= docs.count() and ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_registry():
    names = set(entry.queries())
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in registry.QUERIES} and "pipeline" in names and set(registry.QUERIES) <= names
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "secret_scan", "pack"]


def test_archive_query_is_its_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{data}/pages.parquet')")
    cursor = con.execute(registry.ORACLE_SQL["op5_arc_to_warc"])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in registry.QUERIES["op5_arc_to_warc"](spark, data).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - {"op5_arc_to_warc"}))
def test_query_is_its_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    cursor = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    df = registry.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_mixed_documents_are_rejected(spark):
    import random

    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "über", "ge"], "cc": ["ção", "ll", "ña", "os"]}
    r = random.Random(1)
    say = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(2)) for _ in range(n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(100, " ".join(say(lang, 60) for lang in syllables), "aa"), (101, say("bb", 80) + " " + say("aa", 20), None), (102, say("aa", 30), "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang"] for x in pipeline.language(spark, docs, "").collect()}
    assert 100 not in got and got[101] == "bb" and got[102] == "aa" and all(got[i] == lang for i, _, lang in rows[:60])
