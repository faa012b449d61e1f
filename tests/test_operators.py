"""Cases of single rules as small tables: ties, nulls, empty inputs, order of rows, repeated passes."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from mergestone.functions import classify as C
from mergestone.functions import text as T
from mergestone.operators import elements as E
from mergestone.operators import fusion as U
from mergestone.operators import lifecycle as L
from mergestone.operators import lists as LI
from mergestone.operators import overlay as O
from mergestone.operators import photos as P
from mergestone.operators import resolution as R
from mergestone.operators import triage as TR
from mergestone.operators import versions as V
from mergestone.sources import files as S


def one(spark, column, *values):
    kind = "string"
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize("raw,key", [("Bubbles & Brine (NEW)", "bubbles brine"), ("  The   Alps  ", "the alps"), ("Trio of 3 Cheeses", "trio of 3 cheeses"), ("12 Ounce Ozark Lager", "ozark lager"), ("Frozen Rosé — $9.50", "frozen rose"), ("Frozen Rosé", "frozen rose"), (None, None), ("Menu Booth", "")])
def test_normalize_name(spark, raw, key):
    assert one(spark, T.normalize_name(F.col("x")), raw) == [key]


def test_similarity(spark):
    df = spark.createDataFrame([("the alps", "alps the"), ("the fry basket", "the noodle exchange"), ("abc", "abd"), ("", ""), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(T.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100 and got[1] < 70 and abs(got[2] - 200 * 2 / 6) < 1e-9 and got[3] == 100 and got[4] is None


def test_common_subsequence_against_the_usual_table():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    words = ["", "a", "abcab", "banana", "ananas", "xyz", "the fry basket", "basket of fries " * 6]
    for a, b in itertools.product(words, words):
        assert T._common(a, b) == slow(a, b)


def test_price_clauses(spark):
    names = ["Ale - 6 oz $6.00 / 12 oz $9.75", "Shiraz, Upton Hills - $7.50", "Plain name", "$4.00", "Soup, warm"]
    assert one(spark, T.strip_price_clause(F.col("x")), *names) == ["Ale", "Shiraz, Upton Hills", "Plain name", "$4.00", "Soup, warm"]
    df = spark.createDataFrame([("Soup: with bread - $3", "Soup"), ("Soup - $3", "Soup"), ("Soup: small $2 large $3 each", "Soup")], "l string, n string")
    assert [r[0] for r in df.select(T.description_of(F.col("l"), F.col("n"))).collect()] == ["with bread", None, None]


def test_links_and_files(spark):
    assert one(spark, T.absolute_url(F.col("x"), "h.org"), "//a/b", "/c?d", "e.org/f#g", "https://i/j", "") == ["https://a/b", "https://h.org/c", "https://e.org/f", "https://i/j", None]
    assert one(spark, T.url_year(F.col("x")), "https://a/2024/x", "https://a/best-2025", "https://a/b") == [2024, 2025, None]
    assert one(spark, T.archive_original(F.col("x")), "https://web.x/web/2020id_/https://a/b", "https://a/b") == ["https://a/b", "https://a/b"]
    assert one(spark, T.name_from_file(F.col("x")), "2019-old-mill-booth-300x200.jpg", "booth.jpg", "photo.png", "a-b-c-d-booth.png") == ["Old Mill", None, None, "B C D"]
    assert one(spark, T.slugify(F.col("x")), "A & B!", "--", None) == ["a-b", "item", "item"]


@pytest.mark.parametrize("line,tags", [("Beer-braised Beef", ["contains_alcohol"]), ("Virgin Mojito with Mint", []), ("Root Beer Float", []), ("Roasted Chestnut Soup", ["contains_nuts"]), ("Water Chestnuts and Peas", []), ("Doughnut with Nutmeg", []), ("Zoe Rosé", ["contains_alcohol"]), (None, [])])
def test_dietary_tags(spark, line, tags):
    assert one(spark, C.dietary_tags(F.col("x")), line) == [tags]


def test_flavours_kinds_newness(spark):
    assert one(spark, C.flavour_tags(F.col("x")), "Freshly Baked Carrot Cake with Cream Cheese Icing", "Crab Cake with Mustard Sauce", "Sweet Chile-Lime Chicken Strips", "Sauvignon Blanc") == [["sweet"], ["savory"], ["sweet", "savory"], []]
    assert one(spark, C.alcohol_kind(F.lit("alcoholic_beverage"), F.col("x")), "Apple Hard Cider", "Bourbon Barrel-Aged Zinfandel", "Beer Flight", "Lemonade Sake", "Ginger Beer with Vodka", "Unlabelled") == ["cider", "wine", "beer", "liquor", "liquor", None]
    assert one(spark, C.is_new(F.col("x")), "Wings (New)", "NEW! Waffle", "Cake (Legacy Item) (New)") == [True, None, None]
    assert one(spark, T.strip_new_marker(F.col("x")), "NEW! Waffle", "Wings (new) Hot", "New York Strip", "NEWS") == ["Waffle", "Wings Hot", "New York Strip", "NEWS"]


def candidates(spark, rows):
    return spark.createDataFrame([("e", "f", *r) for r in rows], "entity string, field string, ref long, source long, rank int, observed_at date, value double")


def test_fusion_does_not_depend_on_order(spark):
    d = dt.date
    rows = [(1, 1, 2, d(2026, 1, 9), 5.0), (2, 2, 1, d(2026, 1, 1), 6.0), (3, 3, 1, d(2026, 1, 5), 7.0), (4, 4, 1, d(2026, 1, 5), 8.0), (5, 5, 6, d(2026, 9, 9), None)]
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 29):
        c = candidates(spark, order)
        assert U.fused(c, U.by_priority()).first().ref == 3
        assert U.fused(c, U.by_recency()).first().ref == 5
    assert U.disagreement(candidates(spark, rows), U.by_priority(), numeric=True).first().disagrees
    assert U.fused(candidates(spark, []), U.by_priority()).count() == 0


def test_one_of_equal_candidates_is_selected(spark):
    d = dt.date(2026, 1, 1)
    rows = [(1, 7, 1, d, 2.0), (1, 8, 1, d, 3.0), (1, 8, 1, d, 3.0), (1, 8, 1, d, 1.0), (2, 9, 2, d, 9.0), (3, 9, 1, None, None)]
    for order in itertools.islice(itertools.permutations(rows), 0, 720, 191):
        got = [r for r in U.selected(candidates(spark, order), U.by_priority()).collect() if r.is_selected]
        assert [(r.ref, r.source, r.value) for r in got] == [(1, 8, 3.0)] and U.fused(candidates(spark, order), U.by_priority()).first().value == 3.0


def test_zero_winner_and_union(spark):
    d = dt.date(2026, 1, 1)
    c = candidates(spark, [(1, 1, 1, d, 0.0), (2, 2, 2, d, 0.1)])
    assert U.disagreement(c, U.by_priority(), numeric=True).first().disagrees
    rows = [("e", "f", 1, 1, 2, d, ["b", "a"]), ("e", "f", 2, 2, 1, d, ["c", "a"]), ("g", "f", 3, 3, 0, d, []), ("g", "f", 4, 4, 1, d, ["z"])]
    a = spark.createDataFrame(rows, "entity string, field string, ref long, source long, rank int, observed_at date, value array<string>")
    assert {r.entity: list(r.value) for r in U.union_fused(a).collect()} == {"e": ["c", "a", "b"], "g": []}


def test_versions_of_repeated_and_returning_hashes(spark):
    rows = [(1, 1, 10, "a"), (1, 2, 11, "a"), (1, 3, 12, "b"), (1, 4, 13, "a"), (2, 1, 14, None), (2, 2, 15, None)]
    got = {(r.url, r.version): (r.n_fetches, r.superseded_by) for r in V.versions(spark.createDataFrame(rows, "url int, fetched_at int, fetch_id int, hash string")).collect()}
    assert got == {(1, 1): (2, 12), (1, 2): (1, 13), (1, 3): (1, None), (2, 1): (2, None)}


@pytest.mark.parametrize("supported,force,refused", [(range(0), False, True), (range(0), True, True), (range(3), False, True), (range(3), True, False), (range(4), False, False), (range(10), False, False)])
def test_refusal_guard(spark, supported, force, refused):
    e = spark.createDataFrame([(i, "p", False, True) for i in range(10)], "entity int, parent string, curated boolean, is_active boolean")
    s = spark.createDataFrame([(i,) for i in supported], "entity int")
    got = L.judged(e, s, force).collect()
    assert all(r.refused == refused for r in got)
    assert sum(r.is_active for r in got) == (10 if refused else len(supported))


def test_loss_guard_floor_and_emptied(spark):
    ids = lambda r: spark.createDataFrame([(i,) for i in r], "id int")
    g = lambda b, a, d=range(0): L.loss_guard(ids(b), ids(a), ids(d)).first().refused
    assert not g(range(20), range(5, 20)) and g(range(20), range(6, 20)) and not g(range(20), range(6, 20), range(3)) and g(range(3), range(0)) and not g(range(0), range(0))


def test_matching_ties_and_leaders(spark):
    rec = spark.createDataFrame([(1, "b", "red ale"), (2, "b", "zzz"), (3, "c", "red ale")], "record long, block string, key string")
    ent = spark.createDataFrame([(7, "b", "ale red", False), (8, "b", "ale red", True), (9, "b", "red ale", True)], "entity long, block string, ekey string, is_active boolean")
    got = {r.record: (r.entity, r.outcome) for r in R.matched(rec, ent).collect()}
    assert got == {1: (8, "auto_merge"), 2: (None, "new_entity"), 3: (None, "new_entity")}
    rows = [(i, "b", k) for i, k in enumerate(["apple pie", "apple pies", "apple piez", "pear tart", "pie apple", "pear tarts"])]
    led = {r.record: r.leader for r in R.leader_clusters(spark.createDataFrame(rows, "record long, block string, key string")).collect()}
    assert led == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 3}


def test_triage(spark):
    c = spark.createDataFrame([(1, 2, 8.75), (1, 1, 8.75), (1, 3, 15.0), (2, 1, 8.75), (2, 2, 15.0), (3, 1, 5.0)], "id int, rank int, value double")
    got = {r.id: (r.proposal, r.confidence) for r in TR.numeric_outliers(c).collect()}
    assert got == {1: (8.75, 0.9), 2: (None, None), 3: (None, None)}
    t = spark.createDataFrame([(1, 2, "Red Ale", "red ale"), (1, 1, "red ale", "red ale"), (2, 1, "Ale", "ale"), (2, 2, "Red Ale", "red ale"), (3, 1, "A", "a"), (3, 2, "B", "b")], "id int, rank int, value string, key string")
    assert {r.id: r.proposal for r in TR.text_variants(t).collect()} == {1: "red ale", 2: "Red Ale", 3: None}


def test_overlays(spark):
    kind = "k int, payload map<string,string>"
    base, new = spark.createDataFrame([(1, {"a": "", "b": None, "c": "x"}), (2, {"a": "y"})], kind), spark.createDataFrame([(1, {"a": "n", "b": "n", "c": "n", "d": "n"}), (3, {"a": "z"})], kind)
    got = lambda **k: {r.k: r.payload for r in O.merged(base, new, ["k"], **k).collect()}
    assert got(overwrite=False)[1] == {"a": "n", "b": "n", "c": "x", "d": "n"}
    assert got(overwrite=False, fill="absent")[1] == {"a": "", "b": None, "c": "x", "d": "n"}
    assert got(overwrite=True) == {1: {"a": "n", "b": "n", "c": "n", "d": "n"}, 2: {"a": "y"}, 3: {"a": "z"}}
    d = lambda df: tuple(O.digest(df, "k", "v").first())
    rows = spark.range(50).selectExpr("id AS k", "id % 7 AS v")
    assert d(rows) == d(rows.repartition(7).orderBy(F.desc("k"))) != d(rows.filter("k > 0"))


def test_photos(spark):
    own = spark.createDataFrame([(1, 10, 95), (1, 11, 95), (2, 20, 80)], "photo int, dish int, score int")
    menu = spark.createDataFrame([(2, 30, 92), (3, 30, 91), (4, 10, 99), (5, 40, 95), (5, 41, 95)], "photo int, dish int, score int")
    assert {(r.photo, r.dish, r.stage) for r in P.two_stage(own.select("photo"), own, menu).collect()} == {(1, 10, 1), (2, 30, 2)}
    df = spark.createDataFrame([("red ale of kent", "red ale", "red ale"), ("big mild red ale", "big", "ale red big"), ("x", "x", "y")], "full string, head string, name string")
    scores = [r[0] for r in df.select(P.guide_score(F.col("full"), F.col("head"), F.col("name"))).collect()]
    assert scores[0] == 100 and scores[1] >= 90 and scores[2] == 0


def test_pages(spark):
    html = "<h2>Mill</h2><ul><li>Bread - $2.50</li><li>Free water</li></ul><script>x='$9'</script><p>Tea $3 / $4<p>Next"
    e = E.tokenised(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    assert {(r.parent, r.name, str(r.price)) for r in E.priced_items(e).collect()} == {("Mill", "Bread", "2.50"), ("Mill", "Tea", "3.00")}
    votes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (4, "a"), (4, "b"), (4, "b")], "page_id int, name string")
    assert [(r.page_id, r.name) for r in E.majority(votes).collect()] == [(1, "a")]


def test_lists(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 0.0)], "id int, price double")
    f = lambda v, b: LI.optional_filter(df, p=(v, F.col("price") >= v, b)).count()
    assert f(0, False) == 3 and f(0, True) == 2 and f(None, True) == 3
    assert LI.page(df, ["id"], 2, 2).collect()[0].asDict() == {"id": 3, "price": 0.0, "total": 3}
    assert one(spark, LI.shortened(F.split("x", ","), 2), "a,b,c", "a") == ["a, b and 1 more", "a"]


def test_curated_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"_README": "x", "booths": [{"name": " Mill ", "latitude": 1.5, "note": null, "opens_at": null, "other": "no"}, {"name": " "}, {"latitude": 2}]}')
    got = S.overlay_parents(spark, f"file://{tmp_path}/b.json", ["latitude", "note"], ["opens_at"]).collect()
    assert [(r["name"], r.payload) for r in got] == [("Mill", {"latitude": "1.5", "opens_at": None})]
    (tmp_path / "m.json").write_text('{"menu_items": [{"booth_name": "Mill", "name": "Bread", "category": "food"}, {"booth_name": "Mill", "name": "Nail", "category": "iron"}, {"name": "Lost"}]}')
    rows, rejects = S.overlay_children(spark, f"file://{tmp_path}/m.json", ["food"])
    assert [r["name"] for r in rows.collect()] == ["Bread"] and [r["name"] for r in rejects.collect()] == ["Nail"]
    (tmp_path / "c.json").write_text('{"version": 2, "menu_items": [{"name": "x"}]}')
    with pytest.raises(Exception, match="version 1"):
        S.changeset(spark, f"file://{tmp_path}/c.json").collect()
    for key in ("spring", "autumn"):
        (tmp_path / "f" / key).mkdir(parents=True)
    (tmp_path / "f" / "spring" / "booths.json").write_text('{"n": 1}')
    assert [(r.key, r.n) for r in S.folders(spark, f"file://{tmp_path}/f", "booths.json", "n int").collect()] == [("spring", 1)]
    df = spark.createDataFrame([("ok-1", "image/png", "aGk="), ("../x", "image/jpeg", "aGk="), ("a", "image/png", "!!")], "id string, mime string, data_base64 string")
    got = S.photos(df).collect()
    assert [bytes(r.bytes) for r in got] == [b"hi", b"hi"] and got[0].file == "ok-1.png" and got[1].file.startswith("photo-") and got[1].file.endswith(".jpg")


def test_nearest_against_all_pairs(spark):
    import math
    import random

    from mergestone.operators.lists import nearest

    def metres(a, o, b, q):
        h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(q - o) / 2) ** 2
        return round(2 * 6371000 * math.asin(min(1.0, math.sqrt(h))))

    r = random.Random(3)
    spread = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)]
    crowd = [(100 + i, 10 + r.random() / 100, 20 + r.random() / 100) for i in range(40)]  # far from most points
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(80)] + [(80, 90.0, 0.0), (81, -90.0, 5.0), (82, 0.0, 180.0)]
    for places in (spread + crowd, crowd, crowd[:1], [(7, 1.0, 1.0), (6, 1.0, 1.0)]):
        got = nearest(spark.createDataFrame([*points, (90, None, 1.0)], "id long, lat double, lon double"), spark.createDataFrame([*places, (1, None, None)], "place long, lat2 double, lon2 double"))
        want = {i: min((metres(a, o, b, q), p) for p, b, q in places)[1] for i, a, o in points} | {90: None}
        assert {r.id: r.nearest for r in got.collect()} == want
    none = nearest(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame([], "place long, lat2 double, lon2 double"))
    assert {r.nearest for r in none.collect()} == {None}
