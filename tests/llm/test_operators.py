"""Operators 1, 2, 3, 4, 6, 8 and 10 against brute force, round trips and held-out rows, with odd inputs in every table."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinegraph.llm import byteconv, chat, idstore, linerules, packing, secretscan, vptree

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "word " * 3000, "中文 Ж \U0001f642", "x\ty\r\n z"]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# --- 1


def vectors(n=700, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 8)).astype(np.float32)
    rows = [(i, x[i].tolist(), "c") for i in range(n)]
    same = x[3].tolist()
    rows += [(1000 + i, same, "c") for i in range(60)]
    rows += [(2000, None, "c"), (2020, [], "c"), (2040, [0.0] * 8, "c"), (2060, [float("nan")] + [1.0] * 7, "c"), (2080, [None] + [1.0] * 7, "c"), (2100, [float("inf")] * 8, "c"), (2120, [1.0, 2.0], "c"), (None, same, "c"), (3, same, "c")]
    return rows


@pytest.mark.parametrize(("factor", "shard", "recall"), [(1.0, 100, 1.0), (1.25, 100, 0.9)])
def test_nearest(spark, factor, shard, recall):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = vptree.nearest(table, table.where("vec_id % 20 = 0"), 20, factor, shard).collect()
    good = {i: np.asarray(v, np.float64) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    want = {q: sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:20] for q in good if q % 20 == 0}
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
        assert r["score"] == pytest.approx(float(good[r["query_id"]] @ good[r["vec_id"]]), abs=1e-12)
    assert set(found) == set(want)
    hits = sum(len({i for _, i in f.values()} & {i for _, i in want[q]}) for q, f in found.items())
    assert hits >= recall * sum(map(len, want.values()))
    for f in found.values():
        assert sorted(f) == list(range(1, len(f) + 1)) and [f[k] for k in sorted(f)] == sorted(f.values())
    assert vptree.nearest(table.limit(0), table.limit(0)).collect() == []
    few = vptree.nearest(table.where("vec_id < 5"), table.where("vec_id = 0"), 20, factor, shard).collect()
    assert len(few) == 4


def exact(good, queries, k=20):
    return {q: sorted((-float((np.asarray(good[q]) * np.asarray(v)).sum()), i) for i, v in good.items() if i != q)[:k] for q in queries}


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    return {q: [i for _, i in sorted(x)] for q, x in out.items()}


@pytest.mark.parametrize("shard", [50, 8192])
def test_ties_go_to_the_least_ids(spark, shard):
    r = np.random.default_rng(9)
    good = {0: [1.0] + [0.0] * 7}
    for i in range(1, 201):  # different vectors, all with product 1
        good[i] = [1.0, *map(float, r.integers(-4, 5, 6)), float(i)]
    for i in range(300, 500):
        good[i] = [0.5, *map(float, r.integers(-4, 5, 7))]
    table = spark.createDataFrame(list(good.items()), "vec_id long, embedding array<double>")
    got = ranked(vptree.nearest(table, table.where("vec_id = 0"), 20, 1.0, shard))
    assert got == {0: list(range(1, 21))}


@pytest.mark.parametrize("scale", [1e3, 1e8, 1e30])
def test_a_long_vector_hides_no_neighbour(spark, scale):
    r = np.random.default_rng(10)
    x = r.standard_normal((1200, 8))
    x[17] *= scale
    x[18] /= scale
    good = {i: v.tolist() for i, v in enumerate(x)}
    table = spark.createDataFrame(list(good.items()), "vec_id long, embedding array<double>")
    got = ranked(vptree.nearest(table, table.where("vec_id % 20 = 0"), 20, 1.0, 100))
    assert got == {q: [i for _, i in x] for q, x in exact(good, range(0, 1200, 20)).items()}


def test_recall_at_the_query_s_factor(spark):
    """What op1_vptree_search gives on its table against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    good = {r["vec_id"]: np.asarray(r["embedding"], np.float64) for r in table.collect()}
    got = ranked(vptree.op1_vptree_search(spark, "/root/testdata/sf0.001"))
    want = exact(good, [i for i in good if i % 20 == 0])
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


# --- 2


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_store(spark):
    from twinegraph.llm.common import new_folder

    r = random.Random(8)
    texts = ODD + ["".join(r.choice("abc de\n") for _ in range(r.randint(0, 200))) for _ in range(150)]
    ids = [None, 5, 5, 5] + r.sample(range(-500, 5000), len(texts) - 4)
    docs = documents(spark, texts, ids).selectExpr("*", "'x' AS start", "1 AS ids")
    lib = library(BYTE)
    for size in (1 << 20, 400):
        manifest = idstore.write_store(docs, new_folder(spark, "t"), BYTE, "byte", 0, size)
        got = idstore.read_entries(manifest).collect()
        want = sorted(((k is not None, k or 0, t is not None, t or ""), lib.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in zip(ids, texts, strict=True))
        at, rows = 0, []
        for (known, k, _, _), x in want:
            rows.append((k if known else None, at, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
            at += len(x)
        assert sorted(map(str, (tuple(g) for g in got))) == sorted(map(str, rows))
        if size == 400:
            assert manifest.count() > 4
            one = manifest.where("n_docs > 2").first()
            shard = idstore.Shard(idstore.get_file(one["path"]))
            assert [x.tolist() for x in shard.get(int(shard.keys[-1]))][-1] == shard.ids(shard.n_docs - 1).tolist()
            assert shard.get(987654321) == []
    assert idstore.read_entries(idstore.write_store(docs.limit(0), new_folder(spark, "t"), BYTE)).collect() == []


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    h = idstore.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(keys.size))
    assert idstore.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
    wide = idstore.Shard(idstore.shard_bytes([7], [struct.pack("<I", 70000)]))
    assert wide.width == 4 and wide.get(7)[0].tolist() == [70000]


# --- 3


def test_classifier_tells_apart_rows_it_has_not_seen(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 120))) + "."
    bad = lambda: " ".join([("".join(r.choice("etaoin") for _ in range(4)) + "### ") * r.randint(3, 9) for _ in range(8)])
    texts = [good() if i % 4 else bad() for i in range(400)] + ODD
    docs = documents(spark, texts, [*range(400), *range(900, 900 + len(ODD) - 1), None])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = byteconv.train(docs, labels)
    rows = {x["doc_id"]: x for x in byteconv.score(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in rows.values())
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400))
    unseen = [i for i in range(400) if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == int(i % 4 > 0) for i in unseen]) > 0.95
    kept = byteconv.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in rows.items() if x["predicted"]}
    none = byteconv.train(docs, labels.limit(0))
    assert {x["score"] for x in byteconv.score(docs, none).collect()} == {0.5}
    assert byteconv.score(docs.limit(0), none).collect() == []


def test_gradients_and_blocks():
    m = byteconv.ByteConv()
    text = b"some words, some words and an end" * 3
    g = m.gradients(text, 1.0, 1.0)
    for k in ("E", "W", "V", "u"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        loss = []
        for step in (1e-3, -1e-3):
            p = {n: v.astype(np.float64).copy() for n, v in m.p.items()}
            p[k][at] += step
            other = byteconv.ByteConv()
            other.p = p
            loss.append(-math.log(float(other.probability(other.pooled(text)[None, :])[0])))
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(float(g[k][at]), rel=0.05)
    long = bytes(random.Random(1).choices(range(97, 123), k=5000))
    whole = m.pooled(long)
    byteconv.BLOCK, kept = 7, byteconv.BLOCK
    try:
        assert np.allclose(m.pooled(long), whole, atol=1e-5)
    finally:
        byteconv.BLOCK = kept


# --- 4


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_line_rules(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde#|") for _ in range(r.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    banner = line(40)
    texts = []
    for i in range(120):
        own = "\n".join(line(r.randint(0, 30)) for _ in range(r.randint(1, 6)))
        texts.append(f"{banner}\n{own}" if i % 2 else own)
    texts += [texts[0], texts[0], *ODD, banner + "\n" + " ".join(f"w{i}" for i in range(60)), banner.upper() + "\n" + " ".join(f"v{i}" for i in range(30))]
    docs = documents(spark, texts).union(documents(spark, [texts[1]], [1])).selectExpr("*", "'q' AS n_words", "1 AS line")
    got = linerules.apply_rules(docs, least_documents=20, share=0.02).collect()
    assert len(got) == len(texts) + 1
    rows = {g["doc_id"]: g for g in got}
    for i, t in enumerate(texts):
        g = rows[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == brute_rules(t), t
        n = g["n_words"]
        assert g["base_failed"] == (n < 50 or 100 * g["n_repeat_words"] > 50 * n)
        held = len(banner.split()) if (t or "").lower().startswith(banner) else 0
        assert g["removed_words"] == held
        assert g["kept"] == (not g["base_failed"] and n - held >= 0.5 * n)
    assert linerules.apply_rules(docs.limit(0)).collect() == []
    left = {x["doc_id"]: x for x in linerules.without_frequent_lines(docs, 20, 0.02).collect()}
    for i, t in enumerate(texts):
        want = t if t is None else "\n".join(x for x in t.split("\n") if x.lower() != banner)
        assert left[i]["text"] == want and left[i]["n_chars"] == len(want or "")
    assert linerules.without_frequent_lines(docs, 20, 0.02).columns == docs.columns
    # copies under other ids are documents: their lines become frequent
    copies = documents(spark, ["same line of words\nalone"] * 30 + ["another\ntext"] * 20)
    assert linerules.frequent_lines(copies).count() == 2
    # only lines that more rows hold than the limit go on to be counted by document
    many = copies.union(documents(spark, ["rows of one document"], [7]).crossJoin(spark.range(30).select(F.lit(1).alias("copy"))).drop("copy"))
    common = linerules.common_lines(many, 20)
    assert sorted((x["line"], x["n"]) for x in common.groupBy("line").agg(F.sum("times").alias("n")).collect()) == sorted(
        (x["line"], 30) for x in spark.createDataFrame([("same line of words",), ("alone",), ("rows of one document",)], "t string").select(linerules.line_hash(F.col("t")).alias("line")).collect())
    assert linerules.frequent_lines(many, common=common).count() == 2


# --- 6


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_scan_and_redaction(spark):
    r = random.Random(6)
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = list(ODD)
    for _ in range(200):
        parts = [pick("abcé \n", r.randint(0, 20)) for _ in range(6)]
        parts.insert(2, r.choice(['Password: "', "secret=", "api_key = ", "TOKEN:", "token:short secret = "]) + pick(full + "+/_.=-", r.choice([3, 11, 12, 30])))
        parts.insert(4, r.choice(["AKIA" + pick("ABCXYZ019", r.choice([3, 13, 14, 16])), pick("0123456789abcdef", r.choice([15, 16, 40]))]))
        texts.append(" ".join(parts))
    random_keys = [pick(full, 40) for _ in range(40)]
    texts += [f"see {k} here" for k in random_keys]
    names = ["the_long_function_name_number_2", "Donaudampfschifffahrtsgesellschaft1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "/usr/share/doc/packages/readme/2"]
    texts += [f"see {k} here" for k in names]
    texts.append(" ".join("token=" + pick("abcdef0123456789", 20) for _ in range(700)))
    docs = documents(spark, texts).selectExpr("*", "'z' AS spans", "2 AS base")
    got = {x["doc_id"]: x for x in secretscan.scan(docs).collect()}
    caught = 0
    for i, t in enumerate(texts):
        t = t or ""
        base = [(s["start"], s["kind"], s["end"]) for s in got[i]["base"]]
        assert base == brute_spans(t), t
        more = [s for s in got[i]["spans"] if s["kind"] == 3]
        assert {(s["start"], s["kind"], s["end"]) for s in got[i]["spans"]} >= set(base)
        assert not any(t[s["start"] : s["end"]] in names for s in more)
        caught += any(t[s["start"] : s["end"]] in random_keys for s in more)
    assert caught >= 38
    safe = {x["doc_id"]: x for x in secretscan.redact(docs).collect()}
    assert secretscan.redact(docs).columns == docs.columns
    for i, t in enumerate(texts):
        if not got[i]["spans"]:
            assert safe[i]["text"] == t
            continue
        at, want = 0, ""
        for s in got[i]["spans"]:
            if s["start"] >= at:
                want += t[at : s["start"]] + secretscan.MASK
            at = max(at, s["end"])
        assert safe[i]["text"] == want + t[at:] and safe[i]["n_chars"] == len(safe[i]["text"])
    assert secretscan.redact(docs.limit(0)).collect() == []


# --- 8


def test_chat_round_trip(spark):
    r = random.Random(5)
    bits = ["\\", "#", "### ", "<", "</turn>", "\\h", "\\b", "\n", "### assistant\n", "é", "ok ", chat.TRAP]
    turns = []
    for c in range(40):
        for t in range(r.randint(1, 9)):
            turns.append((c, t, r.choice(["user", "assistant", "system", "odd\n# role"]), "".join(r.choice(bits) for _ in range(r.randint(0, 8))), 1))
    turns += [(None, 1, None, None, 1), (90, None, "user", "x", 1), (90, 1, "assistant", "", 1), (91, 1, "user", "same", 1), (91, 1, "user", "same", 1)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    shuffled = table.orderBy("text", "turn")
    formatted = chat.format_conversations(shuffled)
    got = {x["conv_id"]: x for x in chat.digests(formatted).collect()}
    spans = {x["conv_id"]: x for x in formatted.collect()}
    by = {}
    for c, t, role, text, _ in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    undo = lambda s: s.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")
    for c, ts in by.items():
        said = "".join(f"{a}\n{b}\n" for a, b in ts)
        learned = "".join(b for a, b in ts if a == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        f = spans[c]["formatted"]
        assert g["formatted_chars"] == len(f)
        assert "".join(undo(f[s["start"] : s["end"]]) for s in spans[c]["loss_spans"]) == learned
    assert chat.digests(chat.format_conversations(table.limit(0))).collect() == []
    # the loss columns come from the mask: another mask gives other ones
    off = formatted.withColumn("loss_spans", F.expr("transform(loss_spans, s -> named_struct('start', s.start, 'end', s.end - 1))")).where("exists(loss_spans, s -> s.end > s.start)")
    changed = {x["conv_id"]: x["loss_sha256"] for x in chat.digests(off).collect()}
    assert changed and all(changed[c] != got[c]["loss_sha256"] for c in changed)


def test_a_long_conversation(spark):
    texts = [f"é{i} " * (1 + i % 7) for i in range(3000)]
    table = spark.createDataFrame([(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "assistant", "y" * 3_000_000)], "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat.digests(chat.format_conversations(table)).collect()}
    learned = "".join(t for i, t in enumerate(texts) if i % 3)
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3000, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[2]["loss_chars"] == 3_000_000


# --- 10


def check_pieces(rows, want, window):
    by_doc, by_seq = {}, {}
    for key, start, length, crc, total, seq, offset in rows:
        by_doc.setdefault(key, []).append((start, length, crc, total))
        by_seq.setdefault(seq, []).append((offset, length))
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and total == len(want[key]) and length > 0
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *want[key][at : at + length]))
            at += length
        assert at == len(want[key])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize(("window", "most_open"), [(64, 8192), (64, 3), (4096, 8192)])
def test_packer(window, most_open):
    r = random.Random(window + most_open)
    want = {i: [r.randrange(50_000) for _ in range(int(r.paretovariate(0.8)) % (3 * window) + 1)] for i in range(500)}
    p = packing.Packer(window, most_open)
    rows = []
    for k, ids in want.items():
        p.add(k, struct.pack(f"<{len(ids)}I", *ids))
        rows += p.take()
    rows += p.finish()
    assert check_pieces(rows, want, window) == 0
    assert p.open == 0 and not p.counts.any()


def test_placement_is_the_least_sum_of_squares():
    r = random.Random(11)
    p = packing.Packer(32)
    for k in range(300):
        s = r.randint(1, 31)
        n = p.counts.copy()

        def cost(h):
            c = n.copy()
            c[h] -= h > 0
            c[h + s] += h + s < 32
            return int((c[1:32].astype(int) ** 2).sum())

        usable = [0] + [h for h in range(1, 32 - s + 1) if n[h]]
        assert cost(p._level(s)) == min(map(cost, usable))
        p.add(k, b"\0\0\0\0" * s)


def test_pack_query_rows(spark):
    texts = ODD + ["some words here " * k for k in range(1, 200, 7)]
    docs = documents(spark, texts).selectExpr("*", "3 AS length", "'k' AS offset")
    lib = library(WORD)
    want = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert check_pieces([tuple(x) for x in packing.pack(docs, WORD).collect()], want, 4096) == 0
    assert packing.pack(docs.limit(0), WORD).collect() == []


def test_a_tree_works_on_each_node_once(monkeypatch):
    from twinegraph.llm import vptree

    r = np.random.default_rng(4)
    points, queries = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.normal(size=(3000, 48)), r.normal(size=(300, 48))))
    tree = vptree.Tree(points, leaf=16)
    calls, plain = [], vptree.apart
    monkeypatch.setattr(vptree, "apart", lambda *x: calls.append(1) or plain(*x))
    found = tree.search(queries, 5, np.full(300, -np.inf), 1.0)
    assert len(calls) <= 4 * len(tree.nodes)  # nothing is near enough to rule much out; once per way to a node they were tens of thousands
    products = queries @ points.T
    want = np.sort(products, axis=1)[:, -5]
    for (rows, last), p, w in zip(found, products, want, strict=True):
        assert sorted(rows.tolist()) == np.flatnonzero(p >= w - 1e-12).tolist() and last == pytest.approx(w)
    high = tree.search(queries, 5, np.full(300, 2.0), 1.0)
    assert all(rows.size == 0 and last == -np.inf for rows, last in high)
