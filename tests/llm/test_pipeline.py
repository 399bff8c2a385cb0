"""The pipeline stage by stage: every stage works on all its predecessor kept, and its decisions take effect."""

import collections
import random
import re

import numpy as np
import pytest
from test_corpus_operators import linked, words

import corpus_pipeline
from quire.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows = [(k, " ".join(words(60 + k, k)) + f" mail{k}@host.example.com", "en", f"s{k % 3}") for k in range(60)]
    base = words(100, 4)
    rows += [(100 + k, " ".join(base[:50] + [f"w{k}"] + base[51:]), "en", "s1") for k in range(5)] + [(200, rows[7][1], "de", None), (201, "too short", "en", "s0"), (202, None, "en", "s0"), (203, "again " * 200, "en", "s0")]
    random.Random(1).shuffle(rows)
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(at)).write.parquet(f"{at}/stage{k}")
        out.append(spark.read.parquet(f"{at}/stage{k}"))
    return str(at), out


def test_an_empty_table_and_columns_of_any_name(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rules__kept string, pii_entities string, mix_size string, Kept string, id string, n long"
    rows = [(k, " ".join(words(70 + k, k)) + " a@b.example.com", "en", "s", 9, "a", "b", "c", "d", "e", 7) for k in range(30)] + [(None, None, None, None, None, *"abcde", 7), (40, "", "en", None, 0, *"abcde", 7)]
    for name, held in (("empty", []), ("odd", rows)):
        spark.createDataFrame(held, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.columns
            stage(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            assert k == 4 or docs.columns == before and all(tuple(r)[5:] == (*"abcde", 7) for r in docs.collect())
        assert (docs.count() == 0) == (name == "empty")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == COLUMNS for df in stages[1][:5])


def test_rules_drop_what_they_reject_and_nothing_else(stages):
    before, after = texts(stages[1][0]), texts(stages[1][1])
    assert set(before) - set(after) == {201, 202, 203} and all(before[i] == t for i, t in after.items())


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1][1]), texts(stages[1][2])
    _, parent = linked(before, 5, 80)
    assert set(after) == {i for i in before if parent[i] == i} and len(after) < len(before)


def test_addresses_are_replaced(stages):
    before, after = texts(stages[1][2]), texts(stages[1][3])
    for i, t in after.items():
        old, new = re.findall(r"\S+@\S+", before[i]), re.findall(r"\S+@\S+", t)
        assert len(old) == len(new) and not set(old) & set(new)
        assert re.sub(r"\S+@\S+", "", t) == re.sub(r"\S+@\S+", "", before[i])
    assert {r["doc_id"]: r["n_chars"] for r in stages[1][3].collect()} == {i: len(t) for i, t in after.items()}


def test_the_mix_takes_its_share(stages):
    sizes, taken = collections.Counter(), collections.Counter()
    whole = texts(stages[1][3])
    for r in stages[1][3].collect():
        sizes[r["source"]] += len(r["text"].split())
    for r in stages[1][4].collect():
        assert whole[r["doc_id"]].startswith(r["text"].rstrip())
        taken[r["source"]] += len(r["text"].split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < len(sizes) + 1
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)


def test_sequences_hold_all_ids(spark, stages):
    at, out = stages
    rows = out[5].collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(model.encode(r["text"], add_special_tokens=False).ids) + 1 for r in out[4].collect())
    assert sum(r["length"] for r in rows) == want == sum(len(np.frombuffer(r["ids"], "<u4")) for r in rows)
    by = collections.Counter()
    for r in rows:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 1024
    again = corpus_pipeline.run(spark, at)
    assert again.count() == len(rows) and pack(out[4]).count() == len(rows)
