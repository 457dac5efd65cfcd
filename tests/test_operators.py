"""Operators on small rows with answers worked out by hand, or by a plain version."""

import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.functions.fuzzy import similarity
from larkspur.operators import asof, changes, geo, identity, merge, metrics, quality, ranks, sessions, templates
from larkspur.operators.components import components

D = date.fromisoformat
T = datetime.fromisoformat


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("slice_seconds", [None, 3600])
def test_asof(spark, slice_seconds):
    left = spark.createDataFrame([(1, 10_000), (1, 5), (1, 100), (2, 50), (None, 9)], "k int, s long").withColumn("ts", F.timestamp_seconds("s"))
    right = spark.createDataFrame([(1, 5, "a"), (1, 99, "b"), (1, 101, "c"), (3, 1, "d")], "k int, s long, v string").select("k", F.timestamp_seconds("s").alias("rt"), "v")
    got = rows(asof.asof_join(left, right, ["k"], "ts", "rt", how="left", slice_seconds=slice_seconds), "k", "s", "v")
    assert got == sorted([(1, 10_000, "c"), (1, 5, "a"), (1, 100, "b"), (2, 50, None), (None, 9, None)], key=str)
    near = asof.asof_join(left, right, ["k"], "ts", "rt", within=F.expr("INTERVAL 1 HOUR"), slice_seconds=slice_seconds)
    assert rows(near, "k", "s", "v") == [(1, 100, "b"), (1, 5, "a")]


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 40), st.sampled_from([0, 100]))
def test_global_ranks(spark, seed, n, alone):
    r = random.Random(seed)
    data = [(i, r.randint(0, 6)) for i in range(n)]
    got = ranks.ranked(spark.createDataFrame(data, "id long, v long"), "v", "id", ranges=4, alone=alone).select("id", ranks.ntile(5).alias("t"), ranks.percent_rank().alias("p")).collect()
    order = sorted(data, key=lambda x: (x[1], x[0]))
    for row in got:
        k = order.index((row.id, dict(data)[row.id]))
        small, more = divmod(n, 5)
        sizes = [small + (b < more) for b in range(5)]
        assert row.t == next(b + 1 for b in range(5) if k < sum(sizes[: b + 1]))
        assert row.p == pytest.approx(sum(v < dict(data)[row.id] for _, v in data) / max(1, n - 1))


@pytest.mark.parametrize("hot", [0.0, 0.4, 0.95])
def test_ranks_of_hot_values(spark, hot):
    """A value that most rows have spans several ranges, and keeps one rank."""
    import random

    r = random.Random(7)
    data = [(k, 5 if r.random() < hot else r.randrange(12)) for k in range(900)]
    got = ranks.ranked(spark.createDataFrame(data, "id long, v long"), "v", "id", ranges=16, alone=10).collect()
    order = sorted(data, key=lambda x: (x[1], x[0]))
    assert sorted((x["_row"], x.v, x.id) for x in got) == [(k + 1, v, i) for k, (i, v) in enumerate(order)]
    first = {v: next(k for k, x in enumerate(order) if x[1] == v) + 1 for v in {v for _, v in data}}
    assert all(x["_rank"] == first[x.v] and x["_n"] == 900 for x in got)
    alone = ranks.ranked(spark.createDataFrame(data, "id long, v long"), "v", ranges=16, alone=10).collect()
    assert all(x["_rank"] == first[x.v] for x in alone)


def test_nearest_on_the_sphere(spark):
    """Against every pair, with poles, the date line, one place, no place, ties and missing coordinates."""
    import math
    import random

    from larkspur.operators import geo

    r = random.Random(3)
    at = lambda: (math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180))
    points = [(k, *at()) for k in range(150)] + [(150, 90.0, 0.0), (151, -90.0, 12.0), (152, 10.0, 180.0), (153, 10.0, -179.99), (154, None, 1.0), (155, 0.0, 0.0)]
    far = [(k, *at()) for k in range(60)] + [(60, 0.0, 1.0), (61, 0.0, -1.0), (62, None, None)]
    near = [(k, 48 + r.random() / 50, 11 + r.random() / 50) for k in range(80)]

    def metres(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * geo.RADIUS * math.asin(math.sqrt(min(1.0, h))), 3)

    for places in (far, near, far[:1], far[-1:]):
        got = {x.p: (x.s, x.metres) for x in geo.nearest(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(places, "s int, lat double, lon double"), "p", "s", most_broadcast=0 if places is near else 10**6).collect()}
        assert len(got) == len(points)
        for p in points:
            known = [x for x in places if x[1] is not None]
            if p[1] is None or not known:
                assert got[p[0]] == (None, None)
            else:
                assert got[p[0]][1] == pytest.approx(min(metres(p, x) for x in known), abs=0.002)


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    from larkspur.operators import search

    monkeypatch.setattr(search, "QUERIES", 7)
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.integers(-3, 4, 5)]) for k in range(90)] + [(90, None), (91, [0.0] * 5), (92, [1.0] * 5), (93, [2.0] * 5)]
    items = spark.createDataFrame(rows, "id long, v array<float>")
    got = search.k_nearest_of_each(items.where("id % 3 = 0"), items, "id", "v", 4).collect()
    for q, v in rows[::3]:
        if v is None or not any(v):
            assert not [x for x in got if x["query"] == q]
            continue
        s = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in rows if w is not None and any(w) and i != q)
        assert [(x.place, x.id) for x in sorted(got, key=lambda x: x.place) if x["query"] == q] == [(k + 1, i) for k, (_, i) in enumerate(s[:4])]
    assert search.k_nearest_of_each(items.limit(0), items, "id", "v", 4).count() == 0


def test_names_matched_like_all_pairs(spark):
    """Short, long, repeated, empty and missing names: no pair alike by 0.9 is lost."""
    import itertools
    import random

    from larkspur.functions.fuzzy import similarity
    from larkspur.operators import matching

    r = random.Random(5)
    base = ["".join(r.choice("abcdef") for _ in range(r.randrange(1, 14))) for _ in range(60)] + ["王小明", "王晓明", "aaaa", "aaab"]
    names = base + [x[:k] + r.choice("abcxyz") + x[k + 1 :] for x in base for k in (len(x) // 2,)] + [x + "b" for x in base] + ["", None]
    a = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(names)], "a_id int, name string, block int")
    b = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(names)], "b_id int, name string, block int")
    got = {(x.block, x.a_name, x.b_name) for x in matching.like_names(a.select("name", "block").distinct(), b.select("name", "block").distinct(), ["block"], 0.9).collect()}
    want = {(g, x, y) for g in (0, 1) for x, y in itertools.product({n for k, n in enumerate(names) if k % 2 == g and n}, repeat=2) if similarity(x, y) >= 0.9}
    assert got == want
    best = {x.b_id: x.a_id for x in matching.by_name(a, b, ["block"]).collect()}
    for k, n in enumerate(names):
        s = sorted(((similarity(m, n), i) for i, m in enumerate(names) if m and n and i % 2 == k % 2), reverse=True)
        assert best.get(k) == (s[0][1] if n and s[0][0] >= 0.9 and s[1][0] < s[0][0] else None)


def test_sniff_at_any_cut():
    from larkspur.sources import readers

    for encoding, name in (("utf-8", "UTF-8"), ("gb18030", "GB18030")):
        raw = "编号;姓名\n".encode(encoding) + "".join(f"{k};客户{k}\n" for k in range(40)).encode(encoding)
        assert {readers.sniff(raw[:n])["encoding"] for n in range(60, 140)} == {name}
        assert readers.sniff(raw[:101])["delimiter"] == ";"


def test_upsert_of_null_and_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    batch = spark.createDataFrame([(None, "x"), (1, "y"), (1, "z"), (4, "n")], "k int, v string")
    got = changes.upsert(target, batch, ["k"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(None, "x"), (1, "z"), (3, "c"), (4, "n")], "k int, v string").collect()))


@pytest.mark.parametrize("slice_seconds", [600, 3600, 10**7])
def test_sessions_in_slices(spark, slice_seconds):
    """Slices shorter and longer than the gap change no session, also of a user who has most events."""
    import random as rnd

    r = rnd.Random(2)
    data = [(k, 1 if r.random() < 0.7 else r.randrange(2, 6), T("2024-01-01") + timedelta(seconds=r.randrange(400_000))) for k in range(1500)]
    events = spark.createDataFrame(data, "id long, user long, ts timestamp_ntz")
    got, want = (sessions.sessionize(events, "user", "ts", tie="id", slice_seconds=s) for s in (slice_seconds, None))
    assert rows(got, "id", "session_no", "session_id") == rows(want, "id", "session_no", "session_id")


def test_session_gap_is_strict(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 01:00:01")], "u int, t string").withColumn("ts", F.to_timestamp("t"))
    assert [r.session_no for r in sessions.sessionize(e, "u", "ts").orderBy("ts").collect()] == [1, 1, 2]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z0", f"z{i}") for i in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(1, 41)}, **{f"z{i}": "z0" for i in range(1, 30)}}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(*(st.sampled_from([None, "a", "b", "c"]) for _ in range(3))), min_size=1, max_size=9))
def test_identity_links(spark, people):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "id int, phone string, email string, ext string")
    got = {r.id: r.consumer for r in identity.resolve(df, "id", ["phone", "email", "ext"]).collect()}
    root = list(range(len(people)))

    def linked(a, b):
        for x, y in zip(a, b, strict=True):
            if x is not None and y is not None:
                return x == y
        return False

    def any_link(a, b):
        for k in range(3):
            if a[k] is not None and a[k] == b[k] and not any(a[j] and b[j] and a[j] != b[j] for j in range(k)):
                return True
        return False

    for _ in people:
        for i, a in enumerate(people):
            for j, b in enumerate(people):
                if any_link(a, b):
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i] for i in range(len(people))] == root


def test_alias_chains(spark):
    got = identity.chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old string, new string"))
    assert rows(got, "old", "current") == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")]


def test_changes(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, v string")
    assert rows(changes.keyed_diff(before, after, ["k"]), "_op", "k", "v") == [("delete", 3, "c"), ("insert", 4, None), ("update", 2, "b")]
    many = spark.createDataFrame([("x",), ("x",), (None,)], "v string")
    assert rows(changes.multiset_diff(many, spark.createDataFrame([("x",), (None,), (None,)], "v string")), "v", "_op", "_n") == [("x", "delete", 1), (None, "insert", 1)]
    log = spark.createDataFrame([(1, 1, "insert"), (1, 2, "delete"), (2, 1, "insert"), (2, 3, "delete"), (2, 3, "insert")], "k int, b int, _op string")
    assert rows(changes.current_state(log, ["k"], ["b"]), "k", "b") == [(2, 3)]
    hashes = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").select(changes.row_hash(["y", "x"]).alias("h")).collect()
    assert hashes[0].h != hashes[1].h


def test_merge(spark):
    d = spark.createDataFrame([("M",), ("x",), (None,)], "v string")
    assert rows(d.select(merge.dictionary("v", {"M": "male"}, "other").alias("w")), "w") == [("male",), ("other",), (None,)]
    assert rows(merge.unknown_values(d, "v", {"M": "male"}), "value", "n") == [("x", 1)]
    many = spark.createDataFrame([(1, 2, 1, None, "c2"), (1, 1, 1, "n1", None), (1, 1, 0, "n0", "c0")], "k int, p int, t int, name string, city string")
    assert rows(merge.by_priority(many, ["k"], "p", ["t"]), "name", "city") == [("n1", None)]
    assert rows(merge.coalesced(many, ["k"], "p", ["t"]), "name", "city") == [("n0", "c0")]


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    phone = lambda s: value(X.normal_phone(F.lit(s)))
    assert [phone(s) for s in ("+86 138-0013-8000", "008613800138000", "8613800", "", "13800138000")] == ["13800138000", "13800138000", "8613800", None, "13800138000"]
    assert value(X.normal_email(F.lit(" A@B.c "))) == "a@b.c"
    assert value(X.mask_phone(F.lit("13800138000"))) == "138****8000"
    assert value(X.concat_values(F.lit("a"), F.lit(None), F.lit("b"))) == "ab"
    assert value(X.months_between(F.lit(D("2024-03-01")), F.lit(D("2024-01-31")))) == 2
    assert value(X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert value(X.bigrams(F.lit("会员卡"))) == ["会员", "员卡"] and value(X.bigrams(F.lit(""))) == []
    assert value(geo.haversine(*(F.lit(float(x)) for x in (0, 0, 0, 180)))) == pytest.approx(3.141592653589793 * geo.RADIUS)
    assert similarity("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6) and similarity("", "a") == 0.0


@pytest.fixture(scope="session")
def q(spark):
    data = [("c1", "o1", D("2024-01-01"), 100.0), ("c1", "o2", D("2024-01-31"), 50.0), ("c1", "o3", D("2024-03-01"), 50.0), ("c2", "o4", D("2024-03-10"), 10.0)]
    return spark.createDataFrame(data, "consumer_id string, order_id string, day date, amount double")


def test_templates(spark, q):
    as_of = D("2024-03-31")
    assert rows(templates.repurchase(q, 30), "consumer_id", "orders", "days_to_second", "repurchased") == [("c1", 3, 30, True), ("c2", 1, None, False)]
    assert rows(templates.cohort(q, as_of), "consumer_id", "cohort_start", "active_periods") == [("c1", D("2024-01-01"), [0, 2]), ("c2", D("2024-03-01"), [0])]
    assert rows(templates.cohort(q, as_of, "week", 20), "consumer_id", "active_periods") == [("c1", [0, 4, 8]), ("c2", [0])]
    assert rows(templates.churn(q, as_of, min_orders=2), "consumer_id", "avg_gap_days", "recency_days", "silence_ratio", "at_risk") == [("c1", 30.0, 30, 1.0, False)]
    assert rows(templates.churn(q, as_of, multiplier=0.99, min_orders=2), "at_risk") == [(True,)]
    r = templates.rfm(q, as_of, [("top", "r >= 4 AND f >= 3")], {"recency_days": [7, 25, 60, 90], "frequency": [2, 3, 4, 5], "monetary": [50, 100, 150, 500]})
    assert rows(r, "consumer_id", "r", "f", "m", "segment") == [("c1", 3, 3, 4, "other"), ("c2", 4, 1, 1, "other")]
    edge = templates.rfm(q, D("2024-03-10"), [], {"recency_days": [0, 9, 60, 90], "frequency": [2, 3, 4, 5], "monetary": [50, 100, 150, 500]})
    assert rows(edge, "consumer_id", "r") == [("c1", 4), ("c2", 5)]
    c = templates.clv(q, as_of).where("consumer_id = 'c2'").first()
    assert (c.orders, c.tenure_days, round(c.freq_per_year, 4)) == (1, 30, 12.1667)
    people = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "consumer_id string")
    consent = spark.createDataFrame([("c3", "sms", "granted"), ("c1", "sms", "revoked")], "consumer_id string, channel string, status string")
    got = templates.user_360(people, q, consent, as_of)
    assert rows(got, "consumer_id", "orders", "monetary", "consent_sms", "consent_app") == [("c1", 3, 200.0, False, False), ("c2", 1, 10.0, False, False), ("c3", 0, 0.0, True, False)]


def test_qualifying_orders(spark):
    orders = spark.createDataFrame(
        [("o1", "1", "paid", 5.0, None, T("2024-01-10"), "a"), ("o2", "1", "open", 5.0, None, T("2024-01-10"), "a"), ("o3", "1", "paid", 5.0, T("2024-02-01"), T("2024-01-10"), "a"), ("o4", "9", "paid", 5.0, None, T("2024-01-10"), "a"), ("o5", "1", "paid", 5.0, None, T("2024-01-01"), "a")],
        "order_id string, customer_id string, status string, amount double, paid_at timestamp, created_at timestamp, _customer_source string",
    )
    links = spark.createDataFrame([("a", "1", "c1"), ("b", "9", "c9")], "_source string, customer_id string, consumer_id string")
    assert rows(templates.qualifying(orders, links, ["paid"], D("2024-01-31"), 30), "order_id") == [("o1",)]


def orders_of(spark, links, data):
    """Qualifying orders from (customer, source, status, amount, created, paid); links: source and customer to consumer."""
    o = spark.createDataFrame([(f"o{k}", c, st_, a, cr, pd_, src) for k, (c, src, st_, a, cr, pd_) in enumerate(data, 1)], "order_id string, customer_id string, status string, amount double, created string, paid string, _customer_source string")
    o = o.withColumns({"created_at": F.to_timestamp("created"), "paid_at": F.to_timestamp("paid")})
    people = spark.createDataFrame([(s_, c, who) for (s_, c), who in links.items()], "_source string, customer_id string, consumer_id string")
    return lambda lookback, statuses=("paid", "shipped", "completed"): templates.qualifying(o, people, list(statuses), D("2024-07-01"), lookback)


LINKS = {("s1", "1"): "c1", ("s2", "10"): "c1", ("s1", "2"): "c2", ("s1", "3"): "c3", ("s1", "4"): "c4"}


def test_churn_worked_out(spark):
    one = lambda c, day, status="paid", src="s1", paid=True: (c, src, status, 10.0, f"2024-{day} 10:00:00", f"2024-{day} 10:00:00" if paid else None)
    data = [one("10", "03-01", "completed", "s2", False), one("1", "04-15"), one("1", "06-30"), one("2", "06-01"), one("2", "06-02"), one("2", "06-03", "shipped"), one("3", "05-01"), one("3", "05-11"), one("4", "05-01"), one("4", "05-02"), one("4", "05-03", "refunded"), one("x", "06-15", src="s2")]
    q = orders_of(spark, LINKS, data)(365)
    at = lambda **how: {r.consumer_id: (r.orders, r.avg_gap_days, r.recency_days, r.silence_ratio, r.at_risk) for r in templates.churn(q, D("2024-07-01"), **how).collect()}
    assert at() == {"c1": (3, 60.5, 1, 0.02, False), "c2": (3, 1.0, 28, 4.0, True)}
    assert not at(multiplier=4)["c2"][4] and at(multiplier=3)["c2"][4]
    two = at(min_orders=2)
    assert set(two) == {"c1", "c2", "c3", "c4"} and two["c3"] == (2, 10.0, 51, 5.1, True)
    assert at(min_gap=14)["c2"][3:] == (2.0, False)


def test_lifetime_value_worked_out(spark):
    links = {k: v for k, v in LINKS.items() if v != "c4"}
    data = [("1", "s1", "paid", 800.0, "2022-01-01", "2022-01-01"), ("10", "s2", "completed", 200.0, "2024-03-01", None), ("1", "s1", "paid", 100.0, "2024-04-15", "2024-04-15"), ("1", "s1", "paid", 100.0, "2024-06-30", "2024-06-30")]
    data += [("2", "s1", "shipped", 50.0, "2024-06-21", "2024-06-21"), ("3", "s1", "refunded", 90.0, "2024-06-01", "2024-06-01"), ("3", "s1", "paid", 90.0, "2024-07-02", "2024-07-02"), ("x", "s2", "paid", 999.0, "2024-06-15", "2024-06-15")]
    q = orders_of(spark, links, data)
    at = lambda lookback=365, **how: {r.consumer_id: r for r in templates.clv(q(lookback), D("2024-07-01"), **how).collect()}
    got = at()
    assert set(got) == {"c1", "c2"}
    assert (got["c1"].orders, got["c1"].monetary, got["c1"].tenure_days, str(got["c1"].clv)) == (3, 400.0, 122, "1182.10")
    assert [got["c1"].avg_order_value, got["c1"].freq_per_year, got["c1"].p_alive] == pytest.approx([133.3333, 8.97541, 0.98778], abs=1e-4)
    assert (got["c2"].tenure_days, str(got["c2"].clv)) == (30, "514.94") and got["c2"].p_alive == pytest.approx(0.84648, abs=1e-4)
    assert at(decay=1)["c2"].p_alive == pytest.approx(0.71653, abs=1e-4) and str(at(horizon_days=730)["c2"].clv) == "1029.89"
    assert at(min_tenure_days=60)["c2"].p_alive == pytest.approx(0.92004, abs=1e-4)
    assert (at(1000)["c1"].orders, at(1000)["c1"].tenure_days) == (4, 912)


def test_repurchase_worked_out(spark):
    data = [("1", "s1", "paid", 800.0, "2023-06-01", "2023-06-01"), ("10", "s2", "completed", 200.0, "2024-03-01", None), ("1", "s1", "paid", 100.0, "2024-04-15", "2024-04-15"), ("1", "s1", "paid", 100.0, "2024-06-30", "2024-06-30")]
    data += [("2", "s1", "shipped", 50.0, "2024-05-01 08:00:00", "2024-05-01 08:00:00"), ("2", "s1", "paid", 50.0, "2024-05-01 20:00:00", "2024-05-01 20:00:00"), ("3", "s1", "paid", 70.0, "2024-06-01", "2024-06-01"), ("4", "s1", "refunded", 90.0, "2024-06-01", "2024-06-01")]
    q = orders_of(spark, LINKS, data)
    got = rows(templates.repurchase(q(365), 45), "consumer_id", "orders", "first_order_date", "days_to_second", "repurchased")
    assert got == [("c1", 3, D("2024-03-01"), 45, True), ("c2", 2, D("2024-05-01"), 0, True), ("c3", 1, D("2024-06-01"), None, False)]
    assert not rows(templates.repurchase(q(365), 44), "consumer_id", "repurchased")[0][1]
    assert rows(templates.repurchase(q(400), 90), "consumer_id", "orders", "days_to_second")[0] == ("c1", 4, 274)


def test_rfm_worked_out(spark):
    links = {**{("s1", str(k)): f"c{k}" for k in range(1, 8)}, ("s2", "40"): "c4"}
    one = lambda c, status, amount, created, paid="same", src="s1": (c, src, status, amount, created, created if paid == "same" else paid)
    data = [one("1", "paid", 500.0, "2024-06-29", "2024-06-30"), one("1", "refunded", 900.0, "2024-06-20"), one("2", "paid", 100.0, "2024-04-01"), one("2", "shipped", 100.0, "2024-05-01"), one("2", "completed", 100.0, "2024-06-01"), one("2", "paid", 700.0, "2024-07-02"), one("3", "paid", 40.0, "2024-01-01"), one("3", "paid", 60.0, "2024-03-01"), one("3", "paid", 800.0, "2023-06-01")]
    data += [one("4", "paid", 250.0, "2024-05-01"), one("4", "paid", 250.0, "2024-06-01"), one("40", "paid", 250.0, "2024-06-10", src="s2"), one("40", "paid", 250.0, "2024-06-25 10:00:00", "2024-06-25 23:30:00", "s2"), one("5", "completed", 50.0, "2023-12-01", None), one("x", "paid", 999.0, "2024-06-15", src="s2"), one("7", "cancelled", 80.0, "2024-06-05", None), one("6", "cancelled", 80.0, "2024-06-05", None)]
    q = orders_of(spark, links, data)
    as_of = D("2024-07-01")
    got = rows(templates.rfm(q(365), as_of, []), "consumer_id", "recency_days", "frequency", "monetary", "r", "f", "m")
    assert got == [("c1", 1, 1, 500.0, 5, 2, 4), ("c2", 30, 3, 300.0, 3, 4, 3), ("c3", 122, 2, 100.0, 2, 3, 2), ("c4", 6, 4, 1000.0, 4, 5, 5), ("c5", 213, 1, 50.0, 1, 1, 1)]
    bounds = {"recency_days": [7, 30, 90, 180], "frequency": [2, 3, 4, 5], "monetary": [100, 200, 500, 1000]}
    got = rows(templates.rfm(q(365), as_of, [("high", "m >= 4"), ("near", "r BETWEEN 4 AND 5")], bounds), "consumer_id", "r", "f", "m", "segment")
    assert got == [("c1", 5, 1, 4, "high"), ("c2", 4, 3, 3, "near"), ("c3", 2, 2, 2, "other"), ("c4", 5, 4, 5, "high"), ("c5", 1, 1, 1, "other")]
    tied = rows(templates.rfm(q(365, ("cancelled",)), as_of, []), "consumer_id", "recency_days", "r", "f", "m")
    assert tied == [("c6", 26, 5, 1, 1), ("c7", 26, 4, 2, 2)]


@pytest.fixture(scope="session")
def shop(spark):
    """Two consumers, c1 with a customer in each of two sources; worked out by hand."""

    def table(columns, *data):
        return spark.createDataFrame([tuple(r) for r in data], columns)

    orders = table(
        "order_id string, customer_id string, status string, amount double, at string, store_id string, _source string",
        ("o1", "1", "paid", 100.0, "2024-06-30 10:00:00", "st1", "s1"),
        ("o2", "10", "completed", 50.0, "2024-06-20 10:00:00", "st2", "s2"),
        ("o3", "1", "paid", 30.0, "2024-06-02 00:00:00", "st3", "s1"),
        ("o4", "2", "paid", 70.0, "2024-07-01 23:00:00", "st1", "s1"),
        ("o5", "2", "paid", 5.0, "2024-06-15 10:00:00", "gone", "s1"),
        ("o6", "2", "paid", 6.0, "2024-06-15 10:00:00", None, "s1"),
        ("o7", "2", "paid", 7.0, "2024-06-15 10:00:00", "st4", "s1"),
        ("o8", "x", "paid", 999.0, "2024-06-15 10:00:00", "st1", "s2"),
        ("o9", "1", "paid", 1000.0, "2024-06-01 23:00:00", "st1", "s1"),
        ("o10", "1", "refunded", 2000.0, "2024-06-15 10:00:00", "st1", "s1"),
    ).withColumns({"created_at": F.to_timestamp("at"), "_customer_source": F.col("_source")})
    events = table(
        "event_id string, customer_id string, device_id string, _customer_source string",
        *[("e1", "1", "d1", "s1"), ("e2", None, "d1", "s1"), ("e3", None, "d1", "s1"), ("e4", "2", "d1", "s1"), ("e5", None, "d3", "s1"), ("e6", "x", "d2", "s2"), ("e7", None, "d2", "s1")],
    )
    identities = table("_source string, customer_id string, consumer_id string", ("s1", "1", "c1"), ("s2", "10", "c1"), ("s1", "2", "c2"))
    owners = table("device_id string, consumer_id string", ("d1", "c2"), ("d2", "c1"))
    items = table(
        "item string, order_id string, product_id string, amount double",
        *[("i1", "o1", "p1", 60.0), ("i2", "o1", "p2", 40.0), ("i3", "o2", "p1", 50.0), ("i4", "o4", "p2", 70.0), ("i5", "o8", "p1", 999.0), ("i6", "gone", "p1", 500.0), ("i7", "o10", "p1", 2000.0), ("i8", "o9", "p1", 1000.0), ("i9", "o3", "p9", 30.0)],
    )
    through = items.join(orders.select("order_id", "customer_id", "status", "created_at", "_customer_source"), "order_id")
    return {
        "order": metrics.link_consumers(orders, identities),
        "event": metrics.link_consumers(events, identities, owners=owners),
        "known event": metrics.link_consumers(events, identities),
        "item": metrics.link_consumers(through, identities),
        "store": table("store_id string, region_id string, name string, area double", ("st1", "r1", "one", 10.5), ("st2", "r2", "two", 20.0), ("st3", "r1", "three", 30.0), ("st4", None, "four", None)),
        "region": table("region_id string, name string", ("r1", "east"), ("r2", "north")),
        "customer": table("customer_id string, city string, _source string", ("1", "Shanghai", "s1"), ("10", "Beijing", "s2"), ("2", None, "s1")),
        "consumer": table("consumer_id string, city string", ("c1", "Beijing"), ("c2", None)),
        "product": table("product_id string, category string", ("p1", "milk"), ("p2", "diapers")),
    }


BOUGHT = ("status", "in", ["paid", "shipped", "completed"])
STORE = (("store", "store_id", "store_id"),)
REGION = metrics.Path("name", (*STORE, ("region", "region_id", "region_id")))


def result(shop, metric, as_of="2024-07-01"):
    return rows(metrics.evaluate(metric, shop, D(as_of), ("consumer_id",)), "consumer_id", *metric.dimensions, "value")


def test_metric_by_path_and_window(shop):
    m = metrics.Metric("order", "sum", "amount", "created_at", 30, (BOUGHT,), {"region": REGION})
    assert result(shop, m) == [("c1", "east", 130.0), ("c1", "north", 50.0), ("c2", "east", 70.0), ("c2", metrics.UNLINKED, 18.0)]
    assert result(shop, metrics.Metric("order", "count", filters=(("amount", "gte", 30),))) == [("c1", 5), ("c2", 1)]


def test_metric_ratio(shop):
    one = lambda agg, measure=None, *filters: metrics.Metric("order", agg, measure, filters=filters)
    ratio = lambda a, b, *filters, **more: metrics.Metric("order", "ratio", numerator=a, denominator=b, filters=filters, **more)
    refunded = ("status", "eq", "refunded")
    assert result(shop, ratio(one("count"), one("count", None, refunded))) == [("c1", 5.0), ("c2", None)]
    assert result(shop, ratio(one("sum", "amount", refunded), one("sum", "amount"))) == [("c1", 2000 / 3180), ("c2", 0.0)]
    assert result(shop, ratio(one("sum", "amount"), one("count"), ("status", "eq", "paid"), time="created_at", days=30)) == [("c1", 65.0), ("c2", 22.0)]


def test_metric_first_last_and_days(shop):
    big = ("amount", "gte", 30)
    assert result(shop, metrics.Metric("order", "latest", "amount", "created_at")) == [("c1", 100.0), ("c2", 70.0)]
    assert result(shop, metrics.Metric("order", "earliest", "amount", "created_at", filters=(big,))) == [("c1", 1000.0), ("c2", 70.0)]
    days = metrics.Metric("order", "days_since", None, "created_at")
    assert result(shop, days) == [("c1", 1), ("c2", 0)] and result(shop, days, "2024-07-11") == [("c1", 11), ("c2", 10)]


def test_metric_of_devices_and_items(shop):
    assert result(shop, metrics.Metric("event", "count")) == [("c1", 2), ("c2", 3)]
    assert result(shop, metrics.Metric("known event", "count")) == [("c1", 1), ("c2", 1)]
    city = {"city": metrics.Path("city", (("consumer", "consumer_id", "consumer_id"),))}
    assert result(shop, metrics.Metric("event", "count", dimensions=city)) == [("c1", "Beijing", 2), ("c2", metrics.UNLINKED, 3)]
    of_customer = {"city": metrics.Path("city", (("customer", ("_customer_source", "customer_id"), ("_source", "customer_id")),))}
    assert result(shop, metrics.Metric("event", "count", dimensions=of_customer)) == [("c1", "Shanghai", 1), ("c1", metrics.UNLINKED, 1), ("c2", metrics.UNLINKED, 3)]
    category = {"category": metrics.Path("category", (("product", "product_id", "product_id"),))}
    m = metrics.Metric("item", "sum", "amount", "created_at", 365, (BOUGHT,), category)
    assert result(shop, m) == [("c1", "diapers", 40.0), ("c1", "milk", 1110.0), ("c1", metrics.UNLINKED, 30.0), ("c2", "diapers", 70.0)]


def test_metric_filters_and_measures_by_path(shop):
    count = lambda op, v=None: result(shop, metrics.Metric("order", "count", filters=((REGION, op, v),)))
    assert count("eq", "east") == [("c1", 4), ("c2", 1)] and count("ne", "east") == [("c1", 1)] and count("is_null") == [("c2", 3)]
    area = metrics.Path("area", STORE)
    assert result(shop, metrics.Metric("order", "sum", area)) == [("c1", 81.5), ("c2", 10.5)]
    m = metrics.Metric("order", "sum", area, filters=((REGION, "eq", "east"),), dimensions={"store": metrics.Path("name", STORE)})
    assert result(shop, m) == [("c1", "one", 31.5), ("c1", "three", 30.0), ("c2", "one", 10.5)]
    with pytest.raises(ValueError):
        metrics.evaluate(metrics.Metric("order", "mode"), shop, D("2024-01-31"))
    assert metrics.may_sum(m) and not metrics.may_sum(metrics.Metric("order", "ratio"))


def test_tags(spark):
    orders = spark.createDataFrame([("c1", 100.0), ("c1", 900.0), ("c2", 150.0), ("c3", 20.0), ("c4", None)], "consumer_id string, amount double")
    views = spark.createDataFrame([("c5",)] * 5 + [("c2",)] * 5 + [("c3",)], "consumer_id string")
    people = spark.createDataFrame([(f"c{k}",) for k in range(1, 7)], "consumer_id string")
    tables = {"order": orders, "view": views}
    of = {"revenue": (metrics.Metric("order", "sum", "amount"), "consumer_id"), "orders": (metrics.Metric("order", "count"), "consumer_id"), "views": (metrics.Metric("view", "count"), "consumer_id"), "top": (metrics.Metric("order", "max", "amount"), "consumer_id")}
    tag = lambda *rules, otherwise="no": [r[1] for r in rows(metrics.tag(people, "consumer_id", of, list(rules), tables, D("2024-07-01"), otherwise), "consumer_id", "tag")]
    rule = metrics.Rule
    assert tag(rule("high", (("revenue", "gte", 1000),)), rule("mid", (("revenue", "gte", 100),)), otherwise="low") == ["high", "mid", "low", "low", "low", "low"]
    assert tag(rule("looked", (("orders", "eq", 0), ("views", "gte", 1)))) == ["no", "no", "no", "no", "looked", "no"]
    assert tag(rule("active", (("views", "gte", 5), ("revenue", "gte", 1000)), any=True)) == ["active", "active", "no", "no", "active", "no"]
    assert tag(rule("small", (("top", "lt", 100),))) == ["no", "no", "small", "no", "no", "no"]
    value = lambda *r: spark.createDataFrame(list(r), "consumer_id string, value double")
    assert rows(metrics.changed_keys(value(("a", 1.0), ("b", 2.0), ("c", 3.0)), value(("a", 1.0), ("b", 5.0), ("d", 3.0)), "consumer_id"), "changed", "added", "removed") == [(1, 1, 1)]
    assert rows(metrics.impact(value(("a", 1.0), ("b", 2.0)), value(("a", 1.0), ("c", 2.0)), "consumer_id", "value"), "before", "after", "n") == [(1.0, 1.0, 1), (2.0, None, 1), (None, 2.0, 1)]


def test_quality(spark):
    df = spark.createDataFrame([(1, 5.0), (1, -1.0), (None, 2.0)], "k int, v double")
    assert rows(quality.duplicate_keys(df, ["k"]), "k", "n") == [(1, 2), (None, 1)]
    good, bad = quality.split_rows(df, {"sign": F.col("v") >= 0, "key": F.col("k").isNotNull()})
    assert rows(good, "k", "v") == [(1, 5.0)] and rows(bad, "broken") == [("key",), ("sign",)]
    assert rows(quality.check_rows(df, {"key": F.col("k") > 0}), "rule", "rows", "failed", "passed") == [("key", 3, 1, False)]


def test_cell_index_recall(spark):
    from larkspur.operators import search

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0")
    exact = {(r["query"], r.vec_id) for r in search.k_nearest_of_each(asked, e, "vec_id", "embedding", 10).collect()}
    indexed, centres = search.cells(e, "embedding", 16)
    found = {(r["query"], r.vec_id) for r in search.probe(asked, indexed, centres, "vec_id", "embedding", 10, probes=12).collect()}
    assert indexed.count() == e.count() and len(exact & found) / len(exact) >= 0.9


def test_refresh_brings_the_runner_up(spark):
    records = spark.createDataFrame([("k1", 1, "old"), ("k1", 2, "new"), ("k2", 1, "only"), ("k3", 1, "stays")], "k string, t int, v string")
    winners = spark.createDataFrame([("k1", 2, "new"), ("k2", 1, "only"), ("k3", 1, "stays")], "k string, t int, v string")
    left = records.where("NOT (k = 'k1' AND t = 2) AND k != 'k2'")
    got = merge.refresh(winners, left, records.where("k != 'k3'"), ["k"], ["t"])
    assert rows(got, "k", "v") == [("k1", "old"), ("k3", "stays")]


def test_personal_data_in_later_rows(spark):
    """Mails that begin behind the first 100 rows count, and so do the reference's names."""
    from larkspur.plans.rest import personal

    rows = spark.range(0, 400, 1, 1).select("id", F.when(F.col("id") >= 150, F.concat(F.lit("u"), F.col("id"), F.lit("@mail.test"))).alias("note"), F.lit("x").alias("remark"))
    rows = rows.withColumns({c: F.lit("x") for c in ("home_tel", "addr_line", "id_card", "passport", "ssn")})
    assert personal(rows) == ["home_tel", "addr_line", "id_card", "passport", "ssn", "note"]
