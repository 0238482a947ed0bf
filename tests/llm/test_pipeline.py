"""The pipeline's stages on one small corpus: each keeps the columns, its decisions take effect, and the rest is left alone."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from twinegraph.llm import secretscan, suffix  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = prose(90)
    rows = []
    for i in range(240):
        t = " ".join([(word() + "### ") * 6 for _ in range(20)]) if i % 6 == 5 else prose(r.randint(120, 260))
        if i % 10 == 1:
            t += " password=" + "".join(r.choice("0123456789abcdef") for _ in range(20)) + " end"
        if i in (20, 21, 22):
            t = prose(60) + " " + passage + " " + prose(60)
        if i in (31, 33, 37):
            t = rows[30][1].replace(" ", " ", 1) if i != 37 else rows[30][1] + " tail"
        rows.append((i, t, "en", f"s{i % 3}", len(t), "extra"))
    rows += [(1000, None, None, None, None, None), (1001, "", "en", "s", 0, "x")]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), {r[0]: r[1] for r in rows}, passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, path)
        if name == "packing":
            seen[name] = after.collect()
            break
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        seen[name] = {x["doc_id"]: x for x in after.collect()}
        docs = after
    clean = [i for i in range(240) if i % 6 != 5]
    assert sum(i in seen["quality"] for i in clean) >= 0.97 * len(clean)
    assert sum(i in seen["quality"] for i in range(240) if i % 6 == 5) <= 2
    group = {30, 31, 33, 37} & set(seen["quality"])
    assert set(seen["near_duplicates"]) == set(seen["quality"]) - (group - {min(group)})
    for i, x in seen["repeated_strings"].items():
        if i in (20, 21, 22):
            assert passage[100:-100] not in x["text"] and len(x["text"]) > 200
        elif i in clean:
            assert x["text"] == texts[i]
        assert x["n_chars"] is None or x["n_chars"] == len(x["text"])
    for i, x in seen["secrets"].items():
        if i % 10 == 1 and i < 240 and i in clean and i not in (21, 31):
            assert secretscan.MASK in x["text"] and "password=" not in x["text"] and x["text"].endswith(" end")
        elif i in clean:
            assert x["text"] == seen["repeated_strings"][i]["text"]
    assert {x["doc_id"] for x in seen["packing"]} == set(seen["secrets"])
    whole = corpus_pipeline.run(spark, path)
    assert {(x["doc_id"], x["doc_tokens"]) for x in whole.collect()} == {(x["doc_id"], x["doc_tokens"]) for x in seen["packing"]}
    assert len(corpus_pipeline.STAGES) == 5 and suffix.LENGTH == 400


def test_repeated_passages_of_short_words_are_cut(spark):
    r = random.Random(31)
    prose = lambda n, most=8: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, most))) for _ in range(n))
    passages = [prose(51), prose(60, 6), prose(51, 1), prose(55, 3).replace(" ", "\n", 20), prose(50, 9)]
    alone = [(prose(80), prose(90)) for _ in range(40)]
    texts = [f"{a} {passages[i % 8]} {b}" if i % 8 < len(passages) else f"{a} {b}" for i, (a, b) in enumerate(alone)]
    texts += [passages[0], passages[3].replace("\n", " "), None, ""]
    assert all(len(p) < 400 for p in passages)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    for i, (a, b) in enumerate(alone):
        assert left[i] == (f"{a}  {b}" if i % 8 < len(passages) - 1 else texts[i])
    assert [left[i] for i in range(40, 44)] == ["", "", None, ""]
