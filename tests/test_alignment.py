"""The alignment's rules on hand-made cases, and the whole of it on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from twinegraph.operators import evaluate, functionality, graph, literals, rules
from twinegraph.operators.rounds import cut
from twinegraph.plans.fixpoint import Aligner, result_rows
from twinegraph.sources import turtle


def pairs(spark, rows):
    return spark.createDataFrame(rows, "e1 string, e2 string, score double")


def triples(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_invert_and_closure(spark):
    g = graph.KnowledgeGraph.of(triples(spark, [("a", "p", "x"), ("a", "p", "x"), ("y", "q-", "b")]))
    assert got(g.triples, "s", "p", "o") == [("a", "p", "x"), ("b", "q", "y"), ("x", "p-", "a"), ("y", "q-", "b")]
    assert got(g.remove(triples(spark, [("x", "p-", "a")])).triples, "s") == [("b",), ("y",)]


def test_functionality(spark):
    t = graph.inverse_closure(triples(spark, [("a", "p", "x"), ("a", "p", "y"), ("b", "p", "z")]))
    assert dict(got(functionality.functionality(t), "p", "f")) == pytest.approx({"p": 2 / 3, "p-": 1.0})
    t = triples(spark, [("a", "p", "1"), ("a", "q", "2"), ("b", "p", "1"), ("b", "q", "2")])
    assert got(functionality.pair_functionality(t), "pa", "pb", "f") == [("p-", "q-", 0.5)]
    many = triples(spark, [("a", "p", f"{i:03}") for i in range(60)])
    assert functionality.fact_pairs(many).count() == 60 * 59 // 2
    assert got(functionality.fact_pairs(many, 100), "oa", "ob") == sorted((f"{i:03}", f"{j:03}") for i in range(2) for j in range(i + 1, 60))[:100]


def test_pair_functionality_makes_few_pairs(spark):
    r = random.Random(8)
    t = graph.inverse_closure(triples(spark, [(f"s{r.randrange(25)}", f"p{r.randrange(3)}", f"{'s' if r.random() < 0.3 else 'o'}{r.randrange(30)}") for _ in range(300)]))
    for most in (7, 40, 10**6):
        pairs = functionality.fact_pairs(t, most).collect()
        want = {}
        for x in pairs:
            flip = [p[:-1] if p.endswith("-") else p + "-" for p in (x["pa"], x["pb"])]
            want.setdefault(tuple(sorted(flip)), []).append(tuple(sorted((x["oa"], x["ob"]))))
        assert {(a, b): f for a, b, f in got(functionality.pair_functionality(t, most), "pa", "pb", "f")} == {k: len(set(v)) / len(v) for k, v in want.items()}
    # around a hub of 70,000 facts all pairs' numbers fit, and no pair of them is made
    hub = spark.range(70000).selectExpr("'hub' as s", "'p' as p", "'o' || id as o")
    assert got(functionality.pair_functionality(hub), "pa", "pb", "f") == [("p-", "p-", 1.0)]


def test_pair_functionality_joins_groups_once(spark):
    t = triples(spark, [("a", "p", "1"), ("a", "q", "2"), ("b", "p", "1"), ("b", "q", "2")])
    plan = functionality.pair_functionality(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # of repeated objects, and of their count; the facts hold their subject's groups


def test_alignment_counts_all_pairs_of_a_hub(spark):
    # 500 facts have 124,750 pairs; the one that another subject has too is the last of them
    rows = [("hub", "p", f"o{i:03}") for i in range(500)] + [("other", "p", "o498"), ("other", "p", "o499")]
    t = graph.inverse_closure(triples(spark, rows))
    found = {(a, b): f for a, b, f in got(Aligner(t, t).fun2, "pa", "pb", "f")}
    assert found == {("p-", "p-"): 124_750 / 124_751, ("p", "p"): 0.5}
    capped = {(a, b): f for a, b, f in got(functionality.pair_functionality(t, functionality.MOST_PAIRS), "pa", "pb", "f")}
    assert capped == {("p-", "p-"): 1.0, ("p", "p"): 0.5}


def test_local_functionality_of_lists(spark):
    t = triples(spark, [("a", "p", "x"), ("a", "p", "y"), ("b", "p", "y"), ("b", "p", "z"), ("c", "p", "w")])
    asked = spark.createDataFrame([(1, "a", "p"), (1, "b", "p"), (2, "a", "p"), (2, "c", "p")], "id int, s string, p string")
    assert got(graph.KnowledgeGraph(t).local_functionality_of(asked), "id", "f") == [(1, 1.0), (2, 0.0)]
    asked = spark.createDataFrame([(3, "a", "p"), (3, "a", "p"), (4, "none", "p"), (5, "none", "p"), (5, "a", "p"), (6, "b", "p"), (6, "a", "p"), (6, "c", "p")], "id int, s string, p string")
    assert got(graph.KnowledgeGraph(t).local_functionality_of(asked), "id", "f") == [(3, 0.5), (4, 0.0), (5, 0.0), (6, 0.0)]
    r = random.Random(4)
    rows = sorted({(f"s{r.randint(0, 9)}", r.choice("pq"), f"o{r.randint(0, 6)}") for _ in range(90)})
    lists = sorted({(i, f"s{r.randint(0, 9)}", r.choice("pq")) for i in range(40) for _ in range(r.randint(1, 3))})
    held = {}
    for s, p, o in rows:
        held.setdefault((s, p), set()).add(o)
    want = []
    for i in range(40):
        shared = set.intersection(*[held.get((s, p), set()) for k, s, p in lists if k == i])
        want.append((i, 1 / len(shared) if shared else 0.0))
    t = triples(spark, rows)
    assert dict(got(graph.KnowledgeGraph(t).local_functionality_of(spark.createDataFrame(lists, "id int, s string, p string")), "id", "f")) == pytest.approx(dict(want))


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("e1", "a", 0.9), ("e1", "b", 0.8), ("e2", "b", 0.7)], [("e1", "a"), ("e2", "b")]),
        ([("e1", "a", 0.9), ("e1", "b", 0.9)], [("e1", "a"), ("e1", "b")]),
        ([("e1", "a", 0.9), ("e2", "a", 0.8)], [("e1", "a")]),
        ([("x", "x", 1.0), ("x", "y", 1.0)], [("x", "x")]),
        ([], []),
    ],
)
def test_bilateral_max(spark, rows, want):
    out = rules.bilateral_max(pairs(spark, rows))
    assert got(out, "e1", "e2") == want
    assert got(rules.bilateral_max(out), "e1", "e2") == want


def test_inclusion_adds_and_cuts(spark):
    src = triples(spark, [("a", "p", "x"), ("b", "p", "y"), ("c", "p", "z")])
    dst = triples(spark, [("A", "q", "X"), ("B", "q", "Y")])
    one = pairs(spark, [("a", "A", 1.0), ("x", "X", 0.5)])
    assert got(rules.inclusion(src, dst, one, 3.0), "p", "q", "score") == [("p", "q", 0.5)]
    two = pairs(spark, [("a", "A", 1.0), ("x", "X", 1.0), ("b", "B", 1.0), ("y", "Y", 1.0)])
    assert got(rules.inclusion(src, dst, two, 3.0), "score") == [(1.0,)]


def test_inclusion_of_closed_graphs(spark):
    t1, t2 = (cut(graph.inverse_closure(triples(spark, x))) for x in two_graphs(3))
    assign = cut(rules.bilateral_max(literals.map_literals(t1, t2).unionByName(pairs(spark, [(f"a:{i}", f"b:{i + i % 2}", 0.1 + i / 40) for i in range(30)]))))
    want = got(rules.inclusion(t1, t2, assign, 3.0), "p", "q", "score")
    have = got(rules.inclusion_of_closed(t1, t2, assign, 3.0), "p", "q", "score")
    assert len(want) > 4 and [x[:2] for x in have] == [x[:2] for x in want] and [x[2] for x in have] == pytest.approx([x[2] for x in want])


def test_guarded_merge(spark):
    old = pairs(spark, [("a", "x", 0.7)])
    assert got(rules.guarded_merge(old, pairs(spark, [("a", "y", 0.7), ("b", "z", 0.2)]), old), "e1", "e2", "score") == [("a", "x", 0.7), ("b", "z", 0.2)]


LITERALS = [
    ('"Elvis"', "string", ["Elvis", "elvis"]),
    ('"1990-05-01"^^xsd:date', "date", ["1990-05-01"]),
    ('"42"^^xsd:integer', "quantity", ["42"]),
    ('"42"', "digit", ["42"]),
    ('"1.0"', "digit", ["1.0"]),
    ('"06"', "string", ["06"]),
    ('"+3"^^xsd:integer', "string", ["+3"]),
    ('"-5"^^xsd:integer', "quantity", ["-5"]),
    ('"1e5"^^xsd:double', "quantity", ["1e5"]),
    ('"23.78.9"', "string", ["23.78.9"]),
    ('"818/762-1221"', "string", ["normalized_8187621221"]),
    ('"19900909"', "digit", ["19900909"]),
    ('"1.2"@fr', "string", ["normalized_12"]),
    ('"2001-01-01T00:00:00"^^xsd:dateTime', "string", ["2001-01-01T00:00:00", "2001-01-01t00:00:00"]),
    ('"1999-01-01"^^<http://www.w3.org/2001/XMLSchema#date>', "string", ["normalized_19990101"]),
    ('"--"', "string", ["normalized_"]),
    ('"Coamo_u002C_Puerto_Rico"', "string", ["Coamo,Puerto_Rico", "coamo,puerto_rico"]),
    ('"北京"', "string", ["北京"]),
    ("42", "digit", ["42"]),
]


def test_literal_buckets(spark):
    t = triples(spark, [(x, "p-", "s") for x, _, _ in LITERALS])
    rows = got(literals.buckets(t), "term", "bucket", "key")
    assert rows == sorted((x, b, k) for x, b, ks in LITERALS for k in ks)


def test_date_prefix(spark):
    def score(theirs):
        b = lambda xs: literals.buckets(triples(spark, [(f'"{x}"^^xsd:date', "p-", "s") for x in xs]))
        return got(literals.match_date_prefix(b(["1990-05-01"]), b(theirs)), "e2", "score")

    assert score(["1990-05"]) == [('"1990-05"^^xsd:date', pytest.approx(2 / 3))]
    assert score(["1990"]) == [('"1990"^^xsd:date', pytest.approx(1 / 3))]
    assert score(["1990-05", "1990"]) == [('"1990-05"^^xsd:date', pytest.approx(2 / 3))]
    assert score(["1990-05-01"]) == []


def test_quantity_bands_meet_every_close_pair(spark):
    values = [0.0, 1.0, 1.0 + 5e-10, 1.0 + 2e-9, -1.0, 1e12, 1e12 * (1 + 9e-10), 3.5e-7]
    t = spark.createDataFrame([(str(i), "quantity", v) for i, v in enumerate(values)], "term string, bucket string, num double")
    want = sorted((str(i), str(j)) for i, a in enumerate(values) for j, b in enumerate(values) if a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b)))
    assert got(literals.match_quantity(t, t), "e1", "e2") == want


def test_rule_prefixes_and_pattern(spark):
    cols = "s1 string, s2 string, o string, pm string, o2 string, q string, va double, vq double, rk int"
    t1 = triples(spark, [("A", "p", "s"), ("B", "p", "s"), ("B", "p", "t")])
    t2 = triples(spark, [("u", "q", "S"), ("v", "q", "S")])
    fun = spark.createDataFrame([("p", 0.4), ("q", 0.9)], "p string, f double")
    fun2 = spark.createDataFrame([("p", "p", 0.8)], "pa string, pb string, f double")
    chosen = spark.createDataFrame([("s", "S", "A", "p", "u", "q", 1.0, 1.0, 1), ("s", "S", "B", "p", "v", "q", 0.5, 1.0, 2)], cols)
    assert got(rules.rule_scores(chosen, t1, t2, fun, fun2), "e1", "e2", "score") == [("s", "S", pytest.approx(2 / 3))]
    unlike = spark.createDataFrame([("s", "S", "A", "p", "u", "q", 1.0, 1.0, 1), ("s", "S", "A", "p", "v", "q", 1.0, 1.0, 2)], cols)
    assert got(rules.rule_scores(unlike, t1, t2, fun, fun2), "score") == [(0.4,)]


def test_a_piece_with_one_neighbour_settles_what_is_shared(spark, monkeypatch):
    facts = lambda x: [(f"{x}{i}", f"{x}:{p}", f'"{v}"') for i in range(30) for p, v in (("price", i if i != 8 else 7), ("day", "d"), ("kind", "k"))]
    t1, t2 = (cut(graph.inverse_closure(triples(spark, facts(x)))) for x in "ab")
    cols = "s1 string, s2 string, o string, pm string, o2 string, q string, va double, vq double, rk int"
    rows = [(f"a{i}", f"b{i}", f'"{v}"', f"a:{p}-", f'"{v}"', f"b:{p}-", 1.0, 0.5, k) for i in range(10) for k, (p, v) in enumerate((("price", i if i != 8 else 7), ("day", "d"), ("kind", "k")), 1)]
    looked, shared = [], rules._shared
    monkeypatch.setattr(rules, "_shared", lambda asked, *x: looked.append({r["s1"] for r in asked.collect()}) or shared(asked, *x))
    fun, fun2 = (spark.createDataFrame([], c) for c in ("p string, f double", "pa string, pb string, f double"))
    found = dict(got(rules.rule_scores(spark.createDataFrame(rows, cols), t1, t2, fun, fun2), "e1", "score"))
    assert found == {f"a{i}": 0.5 for i in range(10)}  # a7 and a8 share their price: 1 / 2
    assert looked == [{"a7", "a8"}] * 2


def two_graphs(seed):
    """Two random graphs around shared hubs, literals and rare nodes."""
    r = random.Random(seed)
    a, b = [], []
    for i in range(30):
        for x, out, label, at in (("a", a, "rdfs:label", "a:at"), ("b", b, "rdfs:label", "b:in")):
            if r.random() < 0.9:
                out.append((f"{x}:{i}", label, f'"n{i % 22}"'))
            out += [(f"{x}:{i}", at, f"{x}:hub{i % 2 if r.random() < 0.9 else r.randint(0, 2)}"), (f"{x}:{i}", f"{x}:knows", f"{x}:{r.randint(0, 29)}"), (f"{x}:{i}", f"{x}:year", f'"{1990 + i % 4}"^^xsd:date')]
        a += [(f"a:hub{i % 3}", "rdfs:label", f'"hub{i % 3}"')]
        b += [(f"b:hub{i % 3}", "rdfs:label", f'"hub{i % 3}"')]
    return a, b


def test_short_ways_agree_with_the_long_ones(spark):
    t1, t2 = (cut(graph.inverse_closure(triples(spark, x))) for x in two_graphs(1))
    fun = functionality.merge_least(functionality.functionality(t1), functionality.functionality(t2), ["p"])
    known = cut(literals.map_literals(t1, t2))
    blocks = rules.bootstrap_blocks(t1, t2, rules.bilateral_max(known), fun)
    every = rules.monotone_merge(rules.bootstrap(t1, t2, rules.bilateral_max(known), fun), known, ["e1", "e2"])
    assert got(rules.bootstrap_first(t1, t2, blocks, known), "e1", "e2", "score") == got(rules.first_choice(every), "e1", "e2", "score")
    assign = cut(rules.bilateral_max(every))
    quasi = cut(rules.quasi_equivalence(rules.inclusion(t1, t2, assign, 3.0), rules.inclusion(t2, t1, rules.flipped(assign), 3.0)))
    cols = ("s1", "s2", "o", "pm", "o2", "q", "rk")
    want = got(rules.evidence_selection(rules.evidence_search(t1, t2, assign, quasi), assign), *cols)
    assert want
    for hub in (0, 3):
        assert got(rules.chosen_evidence(t1, t2, assign, quasi, hub=hub), *cols) == want


def test_chosen_evidence_leaves_hubs_closed(spark, monkeypatch):
    n = 150
    facts = lambda x: [(f"{x}{i}", f"{x}:{p}", f'"{v}"') for i in range(n) for p, v in (("price", i), ("day", "d"), ("kind", "k"))]
    t1, t2 = (cut(graph.inverse_closure(triples(spark, facts(x)))) for x in "ab")
    assign = pairs(spark, [(f'"{v}"', f'"{v}"', 1.0) for v in [*range(n), "d", "k"]])
    quasi = spark.createDataFrame([(f"a:{p}{i}", f"b:{p}{i}", 0.5) for p in ("price", "day", "kind") for i in ("", "-")], "p string, q string, score double")
    sizes = []

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(rules, "cut", counted)
    found = got(rules.chosen_evidence(t1, t2, assign, quasi), "s1", "s2", "o", "rk")
    assert found == sorted((f"a{i}", f"b{i}", f'"{v}"', k + 1) for i in range(n) for k, v in enumerate((i, "d", "k")))
    assert max(sizes) < 10 * n  # all pairs around a hub are n * n


def test_chosen_evidence_with_many_partners(spark):
    cols = ("s1", "s2", "o", "pm", "o2", "q", "rk")
    ranks = set()
    for seed, hub in ((1, 0), (2, 2)):
        r = random.Random(seed)
        t1, t2 = (cut(graph.inverse_closure(triples(spark, [(f"{x}{r.randrange(14)}", f"{x}:{r.choice('pqr')}", f"{x}{r.randrange(14)}") for _ in range(40)]))) for x in "ab")
        assign = pairs(spark, [(*k, x) for k, x in {(f"a{r.randrange(10)}", f"b{r.randrange(14)}"): r.choice((0.3, 0.5, 0.97)) for _ in range(14)}.items()])
        quasi = spark.createDataFrame([(f"a:{p}{i}", f"b:{q}{j}", r.choice((0.2, 0.4))) for p in "pqr" for q in "pqr" for i in ("", "-") for j in ("", "-") if r.random() < 0.4], "p string, q string, score double")
        want = got(rules.evidence_selection(rules.evidence_search(t1, t2, assign, quasi), assign), *cols)
        ranks |= {x[-1] for x in want}
        assert got(rules.chosen_evidence(t1, t2, assign, quasi, hub=hub), *cols) == want
    assert ranks >= {1, 2}


def test_scores_of_single_pieces(spark):
    facts = lambda x: [(f"{x}{i}", f"{x}:{p}", f'"{v}"') for i in range(20) for p, v in (("day", i % 2), ("price", i if i < 5 else -i)) if x == "a" or p == "day" or i != 7]
    t1, t2 = (cut(graph.inverse_closure(triples(spark, facts(x)))) for x in "ab")
    assign = cut(pairs(spark, [*((f'"{v}"', f'"{v}"', 0.7) for v in range(5)), ("a9", "b9", 0.5), ("a8", "b2", 0.05)]))
    quasi = spark.createDataFrame([(f"a:{p}{i}", f"b:{p}{i}", 0.3) for p in ("price", "day") for i in ("", "-")], "p string, q string, score double")
    fun = spark.createDataFrame([("a:day-", 0.08), ("b:price-", 0.9)], "p string, f double")
    fun2 = spark.createDataFrame([("a:day-", "a:price-", 0.6)], "pa string, pb string, f double")
    chosen = rules.chosen_parts(t1, t2, assign, quasi)
    assert chosen.single.count() > 0 and chosen.ranked.count() > 0
    plain = cut(rules.rule_scores(chosen.rows(), t1, t2, fun, fun2))
    assert got(rules.chosen_scores(chosen, t1, t2, fun, fun2), "e1", "e2", "score") == got(plain, "e1", "e2", "score")
    fresh = cut(rules.chosen_scores(chosen, t1, t2, fun, fun2, assign))
    assert fresh.where("e1 = 'a9'").count() == 0 < plain.where("e1 = 'a9'").count()
    assert got(rules.guarded(fresh, assign), "e1", "e2", "score") == got(rules.guarded(plain, assign), "e1", "e2", "score")


def test_four_triples_with_a_known_answer(spark):
    a = [("yago:Elvis", "rdfs:label", '"Elvis"'), ("yago:Elvis", "yago:marriedTo", "yago:Priscilla")]
    b = [(s.replace("yago", "dbp"), p.replace("yago", "dbp"), o.replace("yago", "dbp")) for s, p, o in a]
    found = Aligner(*(graph.inverse_closure(triples(spark, x)) for x in (a, b))).run()
    assert found.sums == [2.0, 2.0]
    assert got(result_rows(found), "left", "relation", "right", "score") == sorted([
        ("rdfs:label", "rdfs:subPropertyOf", "rdfs:label", 1.0), ("rdfs:label-", "rdfs:subPropertyOf", "rdfs:label-", 1.0),
        ('"Elvis"', "owl:sameAs", '"Elvis"', 1.0), ("yago:Elvis", "owl:sameAs", "dbp:Elvis", 1.0)])


def test_the_last_round_makes_no_inclusions(spark, monkeypatch):
    made = []
    plain = rules.inclusion_of_closed
    monkeypatch.setattr(rules, "inclusion_of_closed", lambda *x: made.append(1) or plain(*x))
    a = Aligner(*(graph.inverse_closure(triples(spark, [(f"{x}:1", "label", '"n"'), (f"{x}:1", f"{x}:at", f"{x}:2")])) for x in "ab"))
    now = a.round(a.start())
    assert ("a:1", "b:1", 1.0) in got(now.same_as, "e1", "e2", "score") and len(made) == 2
    assert now.sub12.count() >= 2 and len(made) == 4


def test_scores_only_grow_and_stay_in_bounds(spark):
    a, b = [], []
    for i in range(12):
        a += [(f"a:{i}", "a:knows", f"a:{(i * 5 + 1) % 12}"), (f"a:{i}", "a:name", f'"n{i if i % 3 else 0}"'), (f"a:{i}", "a:born", f'"{1950 + i}-01-0{i % 9 + 1}"^^xsd:date')]
        b += [(f"b:{i}", "b:met", f"b:{(i * 5 + 1) % 12}"), (f"b:{i}", "b:label", f'"N{i if i % 3 else 0}"'), (f"b:{i}", "b:birth", f'"{1950 + i}"^^xsd:gYear')]
    aligner = Aligner(*(graph.inverse_closure(triples(spark, x)) for x in (a, b)))
    found = aligner.run()
    assert all(x <= y + 1e-9 for x, y in zip(found.sums, found.sums[1:]))
    assert found.same_as.where("score <= 0 or score > 1").count() == 0
    right = found.assign.where("e1 like 'a:%' and substring(e1, 3) = substring(e2, 3)").count()
    assert right >= 8


def test_evaluation(spark):
    gold = spark.createDataFrame([("a", "x"), ("b", "y")], "e1 string, e2 string")
    r = evaluate.hits_and_mrr(gold, pairs(spark, [("a", "z", 0.9), ("a", "x", 0.5), ("b", "y", 0.4), ("b", "q", 0.4)])).first()
    assert (r["hit1"], r["hit10"], r["mrr"]) == (0.5, 1.0, 0.5 * (0.5 + 0.5))
    r = evaluate.openea(pairs(spark, [("a", "x", 0.9), ("b", "q", 0.5)]), gold, "").first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (1, 1, 1, 0.5, 0.5)
    assert evaluate.openea(pairs(spark, []), gold.limit(0), "").first()["f1"] is None


def test_turtle(spark, tmp_path):
    text = '''@prefix x: <http://e/#> . # a note
    PREFIX y: <http://f/>
    x:a a x:T ; x:p "one" , "two \\"q\\""@en ; .
    x:b x:q """long
    "text" here""" ; x:v "3"^^xsd:int , 4.5 , <http://g/h#i> .
    x:c x:l ( x:d "e" ) ; x:n [ x:m x:f ; x:k [ x:j "z" ] ] ; x:empty () .'''
    rows = set(turtle.parse(text, "t"))
    assert ("x:a", "rdf:type", "x:T") in rows and ("x:a", "x:p", "\"two 'q'\"@en") in rows
    assert ("x:b", "x:v", '"3"^^xsd:int') in rows and ("x:b", "x:v", "4.5") in rows and ("x:b", "x:v", "<http://g/h#i>") in rows
    assert ("x:b", "x:q", "\"long\\n    'text' here\"") in rows and ("x:c", "x:empty", "rdf:nil") in rows
    assert len(rows) == 3 + 4 + 1 + 4 + 2 + 2 + 1
    (tmp_path / "k.ttl").write_text(text)
    g = graph.KnowledgeGraph(turtle.read_turtle(spark, str(tmp_path / "k.ttl")))
    assert {tuple(r) for r in g.triples.where(~F.col("s").startswith("ys:") & ~F.col("o").startswith("ys:")).collect()} == {r for r in rows if not r[0].startswith("ys:") and not r[2].startswith("ys:")}
    start = g.triples.where("p = 'x:l'").select(F.col("o").alias("start"))
    assert got(g.list_items(start), "position", "item") == [(0, "x:d"), (1, '"e"')]


def test_nearest_of_a_name_that_shares_its_vector(spark, tmp_path):
    from twinegraph.plans.catalogue_io import QUERIES

    names = ["Customer#000010000", "Customer#000001000", "Customer#000001000", "Customer#000000007", None]
    spark.createDataFrame([(n,) for n in names], "c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    found = [tuple(r) for r in QUERIES["encoded_nearest"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted([(n, n) for n in names], key=str)
    vec = [(k, [1.0, 0.0]) for k in ("a", "b")]
    v = spark.createDataFrame(vec, "key string, vec array<double>")
    assert got(literals.match_embedding(v, v, 0.5, block=1), "key1", "key2") == [("a", "a"), ("b", "b")]


def test_own_names_need_no_search(spark, monkeypatch):
    r = random.Random(9)

    def vec():
        x = [r.gauss(0, 1) for _ in range(8)]
        n = sum(v * v for v in x) ** 0.5
        return [v / n for v in x]

    have = {f"k{i}": vec() for i in range(40)}
    here = {k: v for k, v in have.items() if k < "k3"} | {f"n{i}": vec() for i in range(6)} | {"k30": vec()}  # k30 has another vector there
    searched = []
    blocks = literals._block_nearest
    monkeypatch.setattr(literals, "_block_nearest", lambda e1, *x: searched.extend(q["key"] for q in e1.collect()) or blocks(e1, *x))
    one, two = (spark.createDataFrame(list(x.items()), "key string, vec array<double>") for x in (here, have))
    found = {a: (b, s) for a, b, s in got(literals.match_embedding(one, two, -2.0, 7), "key1", "key2", "score")}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {k: max((dot(v, w), n) for n, w in have.items()) for k, v in here.items()}
    assert {k: b for k, (b, _) in found.items()} == {k: n for k, (_, n) in want.items()}
    assert {k: s for k, (_, s) in found.items()} == pytest.approx({k: s for k, (s, _) in want.items()})
    assert sorted(searched) == sorted(k for k in here if k not in have or k == "k30")


def test_total_and_asked_pairs_without_all_pairs(spark):
    r = random.Random(5)
    facts = lambda x: [(f"{x}{i}", p, f'"{r.randrange(n)}"^^xsd:string') for i in range(60) for p, n in (("day", 3), ("price", 25), ("kind", 2)) for _ in range(2)]
    t1, t2 = (graph.inverse_closure(triples(spark, facts(x))) for x in "ab")
    now = Aligner(t1, t2).start()
    every = {(e1, e2): s for e1, e2, s in got(now.same_as, "e1", "e2", "score")}
    for small in (0, 30, 10**6):
        assert rules.bootstrap_total(t1, t2, now.begin.blocks, now.begin.known, small) == pytest.approx(sum(every.values()), abs=1e-9)
    asked = spark.createDataFrame([("a7",), ("a7",), ("a9",)], "e1 string")
    assert {(e1, e2): s for e1, e2, s in got(now.same_as_of(asked), "e1", "e2", "score")} == {k: s for k, s in every.items() if k[0] in ("a7", "a9")}
    # no plan pairs other nodes: what is asked for is joined before the blocks are opened
    plan = now.same_as_of(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") > plan.index("Join Inner")


def test_all_pairs_from_classes(spark):
    r = random.Random(6)
    facts = lambda x: [(f"{x}{i}", p, f'"{r.randrange(n)}"^^xsd:string') for i in range(50) for p, n in (("day", 3), ("price", 25), ("kind", 2)) for _ in range(2)]
    t1, t2 = (cut(graph.inverse_closure(triples(spark, facts(x)))) for x in "ab")
    now = Aligner(t1, t2).start()
    plain = cut(now.begin.rows())
    old, want = {}, {}
    for e1, e2, x in got(plain, "e1", "e2", "score"):
        old[e1, e2] = max(x, old.get((e1, e2), 0))
    higher = [(e1, e2, 0.5) for e1, e2 in r.sample(sorted(old), 200)] + [("a1", "new", 0.3), ("new", "b1", 1.0)]
    want = old | {(e1, e2): max(x, old.get((e1, e2), 0)) for e1, e2, x in higher}
    risen = cut(pairs(spark, higher))
    for small in (0, 30):
        parts = rules.bootstrap_parts(t1, t2, now.begin.blocks, now.begin.known, small)
        made = parts.rows(risen, chunk=7)
        assert got(made, "e1", "e2", "score") == sorted((*k, x) for k, x in want.items())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")  # opened pairs go through no exchange
    assert got(parts.scores(risen), "e1", "e2", "score") == sorted((e1, e2, old[e1, e2]) for e1, e2, _ in higher if (e1, e2) in old)
