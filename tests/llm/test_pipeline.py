"""The pipeline's stages take effect and keep clean documents."""

import os
import random

import corpus_pipeline
from quadrille.llm import near_dedup
from quadrille.llm.registry import oracle_sql, queries


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]
    assert len(queries()) == 10 and set(oracle_sql()) <= set(queries())


def test_stages(spark, tmp_path):
    import random

    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    passage, long = say(12), say(80)
    rows = [(k, say(60), "en", "s", 0) for k in range(40)] + [(100, long, "en", "s", 0), (101, long + " end", "en", "s", 0), (102, say(40) + " " + passage + " " + say(40), "en", "s", 0), (103, say(30) + " me@mail.example.com", "en", "s", 0), (104, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {row.doc_id: row for row in docs.collect()}
    assert 104 not in seen["language_id"] and set(range(40)) <= set(seen["bpe"])
    assert 101 not in seen["near_dedup"] and 100 in seen["near_dedup"]
    assert passage not in seen["decontamination"][102].text and "[EMAIL]" in seen["pii"][103].text
    assert all(row.n_tokens == len(row.ids) for row in seen["bpe"].values())


def test_language_stage_keeps_long_documents(spark):
    import random

    r = random.Random(5)
    kinds = {lang: ["".join(r.choice("etaoinshrdlu") for _ in range(6)) for _ in range(2000)] for lang in ("aa", "bb")}
    say = lambda lang, n: " ".join(r.choice(kinds[lang]) for _ in range(n // 7))
    rows = [(k, say(lang, 1000), lang, "s", 0) for k in range(160) for lang in [("aa", "bb")[k % 2]]] + [(1000 + k, say(lang, 3_000_000), lang, "s", 0) for k, lang in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {row.doc_id for row in corpus_pipeline.identify_language(spark, docs, "").select("doc_id").collect()} == {row[0] for row in rows}


def test_the_near_duplicate_stage_holds_disk_in_proportion(spark, monkeypatch):
    r, rows = random.Random(4), []
    say = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    base, passages = say(200), [say(7) for _ in range(24)]
    for k in range(500):
        words = base[:]
        for passage in r.sample(passages, 4):
            at = r.randrange(190)
            words[at : at + 7] = passage
        rows.append((k, " ".join(words)))
    written, cut = [], near_dedup.cut

    def counted(df, *partitions):
        table = cut(df, *partitions)
        written.append(sum(os.path.getsize(f.removeprefix("file://")) for f in table.inputFiles()))
        return table

    monkeypatch.setattr(near_dedup, "cut", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").count()
    assert 0 < kept <= len(rows)
    assert sum(written) < 2 * sum(len(t) for _, t in rows)
