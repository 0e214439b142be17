"""Golden cases of the listing operators, on handmade frames."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lotwise import queries
from lotwise.config import Config
from lotwise.functions import scalars as S
from lotwise.functions import text as X
from lotwise.functions.markup import Page
from lotwise.operators import duplicates, evaluation, outliers, pricing, quantiles, queues, review, rules, status, upserts
from lotwise.sources import pages

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean"}
    schema = ", ".join(f"`{k}` {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("out")).first()[0]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_spec_line(spark):
    s = one(spark, X.spec_line(F.col("t")), t="2015 г., б/у седан, 2.5 л, бензин, КПП автомат, с пробегом 120 000 км, белый, литые диски")
    assert (s.year, s.mileage_km, s.engine_volume, s.engine_type, s.transmission, s.body_type, s.condition) == (2015, 120000, 2.5, "бензин", "автомат", "седан", "б/у")
    assert s.description == "белый, литые диски"
    s = one(spark, X.spec_line(F.col("t")), t="2024 г., новый кроссовер, 1,5 л, газ-бензин, КПП механика, без пробега, полная комплектация")
    assert (s.mileage_km, s.engine_volume, s.engine_type, s.transmission, s.condition, s.description) == (0, 1.5, "газ-бензин", "механика", "новый", "без пробега, полная комплектация")
    s = one(spark, X.spec_line(F.col("t")), t="2010 г., б/у, не пикап, а микроавтобус, дизель, КПП механика, продам   \u00a0 ")
    assert (s.body_type, s.description) == ("микроавтобус", "продам")
    s = one(spark, X.spec_line(F.col("t")), t=None)
    assert s.year is None and s.mileage_km is None and s.description == ""


def test_titles_and_urls(spark):
    for title, want in {"Toyota Camry": ("Toyota", "Camry"), "Land Rover Range Rover": ("Land Rover", "Range Rover"), "ВАЗ (Lada) 2107": ("ВАЗ (Lada)", "2107"), "Audi": ("Audi", None)}.items():
        assert tuple(one(spark, X.brand_model(F.col("t")), t=title)) == want
    assert one(spark, X.full_size(F.col("t")), t="http://x/1-160x120.webp") == "http://x/1-full.webp"
    assert one(spark, X.full_size(F.col("t")), t=None) == ""
    assert one(spark, X.without_query(F.col("t")), t="/a/show/1?x=2") == "/a/show/1"


def test_numbers(spark):
    for text, want in {"50.0": 50, "50": 50, "": None, "x": None}.items():
        assert one(spark, X.int_of(F.col("t")), t=text) == want
    assert one(spark, X.int_of(F.col("t")), t=50.0) == 50
    assert one(spark, X.clean_int(F.col("t")), t="12 500 000 ₸") == 12500000
    for km, junk in {777777: True, 888888: True, 99999: False, 111111: False, 150000: False, 0: False}.items():
        assert one(spark, S.is_junk_mileage(F.col("t")), t=km) is junk
    assert one(spark, S.hamming(S.hash_of_hex(F.lit("ffffffffffffffff")), S.hash_of_hex(F.lit("0000000000000001")))) == 63
    assert one(spark, S.round_even(F.lit(-0.125))) == -0.12


def test_dates(spark):
    for text, want in {"18 июля": date(2026, 7, 18), "18 июл.": date(2026, 7, 18), "31 июня": None, "вчера": None, "5 foo": None}.items():
        assert one(spark, S.posted_date(F.col("t"), 2026), t=text) == want, text


def test_damage(spark):
    hit = lambda t: one(spark, X.lexicon_hits(F.col("t"), X.DAMAGE), t=t)
    assert hit("Есть ржавчина на пороге") == ["ржавчин"]
    assert hit("без единой ржавчины") == []
    assert hit("нету никаких гнилей") == []
    assert hit("вложения не требует") == []
    assert hit("без матора, без коробки") == ["без коробки", "без матора"]
    assert hit("салон не прокурен, есть ржавчина") == ["ржавчин"]
    assert hit("битая, не крашена") == ["битая"]
    assert hit(None) == [] and hit("") == []


def test_text_features(spark):
    f = one(spark, X.text_features(F.col("t")), t="Срочно! Кожа, люк, камера, не бит, не крашен")
    assert (f.txt_opt_count, f.txt_positive, f.txt_urgency, f.txt_damage) == (3, 1, 1, 0)


def test_pages(spark):
    html = '<dl><dt>Привод</dt><dd>полный</dd><dt>Пробег</dt><dd>12&nbsp;000 км</dd></dl><div class="offer__parameters-mortgaged">Аварийная</div><script>{"avgPrice": 5000, "descriptionText": "\\u0434а<br/>нет"}</script>'
    df = spark.createDataFrame([(1, html), (2, "Too Many Requests"), (3, '<div class="js__a-card">Too Many Requests</div>')], "id int, html string")
    got = {r.id: r for r in pages.listing_pages(df).collect()}
    assert (got[1].drive, got[1].page_mileage_km, got[1].market_price, got[1].page_status_badge, got[1].seller_comment) == ("полный", 12000, 5000, "Аварийная", "да нет")
    assert (got[2].is_blocked, got[3].is_blocked, got[2].page_status_badge, got[2].market_price) == (1, 0, "-", -1)
    card = lambda i: f'<div class="js__a-card" data-id="{i}"><a href="/a/{i}?q=1"><span class="card__title">BMW X{i}</span></a><span class="card__price">{i} 000 000 ₸</span><img src="http://p/{i}-1x2.jpg"><img src="http://p/static/b.png"></div>'
    got = pages.cards(spark.createDataFrame([(card(1) + card(2),)], "html string")).orderBy("ad_id").collect()
    assert [(r.ad_id, r.brand, r.model, r.price_tenge, r.urls, r.url) for r in got] == [(str(i), "BMW", f"X{i}", i * 1000000, [f"http://p/{i}-full.jpg"], f"/a/{i}") for i in (1, 2)]


def test_elements_within_elements(spark):
    inside = lambda html: one(spark, X.inside(F.col("t"), r"\bx\b"), t=html)
    assert inside('<p>a</p><div class="b x"><div>1</div> 2 <DIV>3</DIV></div><div>4</div>') == "<div>1</div> 2 <DIV>3</DIV>"
    assert inside('<b class="x"><big>1</big>2</b>3') == "<big>1</big>2" and inside('<i class="x">1<br>2') == "1<br>2"
    assert inside('<i class="y">1</i>') == "" and inside(None) is None
    assert one(spark, X.badge(F.col("t")), t='<div class="offer__parameters-mortgaged"><div>Аварийная</div> Заложена</div><div>x</div>') == "Аварийная Заложена"
    text = lambda html: one(spark, X.html_text(F.col("t")), t=html)
    assert text("a&nbsp;<b>b</b>&amp;lt; &eacute;&#1076;&#x434; &no; & &#xD800; &apos;") == "a b &lt; éдд &no; & &#xD800; '"
    assert one(spark, F.array_join(X.reasons_of(F.col("t")), "+"), t="a; |b | c;") == "a+b+c"


def test_page_parser(spark):
    html = """<p>no card</p><!-- <div class="js__a-card" data-id=9></div> --><script>var x = '<div class="js__a-card">';</script><![if IE]>
      <div data-id=1 class=js__a-card><a name=top><a class=x href='/a/show/1?q=2'><h5 class='a-card__title'>BMW <i>X1</i> Добавить в избранное</h5></a>
      <span class=a-card__price>1 000 000 &#8376;<p>30 000 ₸/мес</span><img alt="2020 г., б/у седан, 2 л, бензин" src=http://p/1-1x2.jpg><br/><img src="http://p/1-3x4.jpg"></b><template><img src="http://p/2-3x4.jpg">hidden</template>
      <span class="thumb-gallery__count">7</span><b class="a-label__text">Top</b><b class="a-label__text">New</b><em class=nb-views>1 234</em><span data-test=region>Town</span></div>
      <DIV CLASS="js__a-card vip-card" DATA-ID="2"><b class="vip-card__title">Audi A4<b class="a-card__price">5</b><b class="vip-card__price">2 000 ₸</b><b class="a-card__param--date">18 июля
      <div class="js__a-card" data-id="3"><u class="a-card__title">Audi A6</u>"""
    df = spark.createDataFrame([(1, html, "x"), (2, None, "y"), (3, "", "z"), (4, "<p>js__a-card", "w")], "id int, html string, title string")
    got = pages.cards(df)
    assert got.columns.count("title") == 1
    got = {r.ad_id: r for r in got.withColumn("ok", pages.is_listing()).collect()}
    assert sorted(got) == ["1", "2", "3"]
    a, b, c = got["1"], got["2"], got["3"]
    assert (a.id, a.title, a.brand, a.model, a.url, a.spec.year, a.spec.body_type, a.city) == (1, "BMW X1", "BMW", "X1", "/a/show/1", 2020, "седан", "Town")
    assert (a.urls, a.photos_count, a.photo_url, a.views_count, a.labels, a.is_vip, a.has_monthly_price) == (["http://p/1-full.jpg", "http://p/2-full.jpg"], 7, "http://p/1-full.jpg", 1234, "Top|New", 0, 1)
    assert (b.title, b.price_tenge, b.posted_date, b.is_vip, b.has_monthly_price, b.photos_count, b.photo_url, b.url) == ("Audi A4 5 2 000 ₸ 18 июля", 2000, "18 июля", 1, 0, 1, "", "/a/2")
    assert (c.title, c.price_tenge, c.is_vip, a.ok, b.ok, c.ok) == ("Audi A6", None, 0, True, True, False)
    assert a.price_tenge == 100000030000  # what stands within the price's element counts, digits and all


def test_page_facts_by_parser(spark):
    html = "<h1>Битая <b>BMW</b></h1><dl><dt title='a>b'>Привод<dd>полный<dt>Руль</dt> <dd><i>слева</i></dd></dl><dl><dt>VIN</dt></dl><dl><dd>stray</dd></dl><!--<dl><dt>Цвет</dt><dd>red</dd></dl>--><section class='a offer__description'><p class=text>без коробки, люк</p></section><p class='offer__parameters-mortgaged-x'>no</p><P CLASS=\"z offer__parameters-mortgaged\">В&nbsp;залоге</P>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    got = {r.id: r for r in pages.listing_pages(df).collect()}
    assert (got[1].drive, got[1].steering, got[1].has_vin, got[1].color, got[1].options_text, got[1].page_status_badge, got[1].damage_keywords) == ("полный", "слева", None, None, "без коробки, люк", "В залоге", "без коробки|битая")
    assert [(got[i].drive, got[i].options_text, got[i].page_status_badge, got[i].damage_keywords) for i in (2, 3)] == [(None, "", "-", "")] * 2


def test_page_elements_are_those_of_a_tree():
    """Random markup of nested and unclosed elements against sets of ancestors kept the plain way."""
    dice = random.Random(5)
    for _ in range(300):
        html, tree, stack = "", [], []
        for n in range(40):
            tag = dice.choice("abc")
            if dice.random() < 0.5:
                html += f"<{tag}>"
                tree.append((tag, []))
                stack.append(len(tree) - 1)
            elif dice.random() < 0.5:
                html += f"</{tag}>"
                if tag in [tree[i][0] for i in stack]:
                    while tree[stack.pop()][0] != tag:
                        pass
            else:
                html += f"t{n} "
                for i in stack:
                    tree[i][1].append(f"t{n}")
        page = Page(html)
        assert [(name, page.text(i).split()) for i, name in enumerate(page.names)] == tree
    for odd in ("<", "<!", "<![", "<!--", "</", "<a", "<a b='", "<?", "&", "&#", "<![CDATA[x]]>y", "<!ELEMENT", "<script>", "<p" * 2000, "<p>" * 50000):
        Page(odd)


def test_hard_rules(spark):
    data = [(1, 2000.0, 5e6, 0.0, 27, "б/у"), (2, 2026.0, 5e6, 0.0, 1, "б/у"), (3, 2027.0, 5e6, 10.0, 0, "новый"), (4, 2027.0, 5e6, 0.0, 0, "новый"), (5, None, None, None, None, None), (6, 1940.0, 1e5, 2e6, 87, None), (7, 2024.0, 3e6, None, 3, None), (8, 2024.0, 3e6, None, 3, "б/у")]
    df = spark.createDataFrame(data, "id int, year double, price double, km double, age int, condition string")
    out = df.select("id", rules.hard_rules(F.col("year"), F.col("price"), F.col("km"), F.col("age"), F.col("condition")).alias("r"))
    assert dict(rows(out, "id")) == {1: "used_but_zero_mileage", 2: "", 3: "km_per_year_extreme", 4: "", 5: "", 6: "year_too_old|price_too_low|mileage_extreme", 7: "", 8: "young_car_cheap"}


def test_exculpation_order(spark):
    low, young = "price_anomaly_low", "young_car_cheap"
    cases = {
        "plain": ((low, "", None, None, None, None, None), (low, "", "")),
        "damage": ((low, young, "битая", None, None, None, None), ("", "", "low_price_explained")),
        "dealer": ((low, young, None, "новый", None, None, None), ("", young, "dealer_financing_price")),
        "market": ((low, "", None, None, 5.5e6, None, None), ("", "", "market_price_ok")),
        "sentinel": ((low, "", None, None, -1.0, None, None), (low, "", "")),
        "urgent": ((low, "", None, None, None, "Срочно", None), (low + "|cheap_and_urgent", "", "")),
        "fraud": (("", "", None, None, None, None, "fraud"), ("confirmed_by_review", "", "")),
        "fraud and damage": ((low, "", "битая", None, None, None, "fraud"), ("confirmed_by_review", "", "low_price_explained")),
    }
    df = spark.createDataFrame([(k, *v[0], 5e6) for k, v in cases.items()], "id string, stat_reasons string, rule_reasons string, text_full string, condition string, market_price double, description string, verdict string, price_tenge double")
    got = {r.id: (r.stat_reasons, r.rule_reasons, r.info_flags) for r in rules.exculpate(df).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
    bare = rules.exculpate(spark.createDataFrame([(1, low)], "id int, stat_reasons string"))
    assert bare.first().stat_reasons == low


def test_finalize_keeps_no_blanks(spark):
    df = rules.finalize(spark.createDataFrame([("a", "", "b"), ("", None, "")], "rule_reasons string, stat_reasons string, dup_reasons string"))
    assert rows(df, "is_suspicious") == [("", 0), ("a|b", 1)]


def test_hierarchical_z(spark):
    data = [(i, "m", "b", 10.0 + 0.01 * i) for i in range(20)] + [(20, "m", "b", 2.0), (21, "m", None, 10.0), (22, "m", "b", None)]
    df = spark.createDataFrame(data, "id int, m string, b string, x double")
    got = {r.id: r for r in outliers.hierarchical_z(df, "x", [("both", ["m", "b"]), ("m", ["m"])]).collect()}
    assert [i for i, r in got.items() if r.price_z is not None and abs(r.price_z) > 3.5] == [20]
    assert got[21].z_group_level == "m" and got[22].price_z is None and got[22].z_group_level == "m"
    few = outliers.hierarchical_z(df.limit(5), "x", [("m", ["m"])]).first()
    assert (few.price_z, few.z_group_level) == (0.0, "")


def test_reposts(spark):
    base = ("Camry", 2015, 5e6)
    data = [(1, *base, 100000.0, "x y", None, None, "red"), (2, *base, 100000.0, "z", None, None, "Red dark"), (3, "Audi", 2010, 1e6, 50.0, None, None, None, None), (4, "Audi", 2010, 1e6, 50.0, None, None, None, None), (5, *base, 1.0, None, "новый", None, None), (6, None, 2010, 1e6, 9e4, "q", None, None, None), (7, None, 2010, 1e6, 9e4, "q", None, None, None)]
    df = spark.createDataFrame(data, "ad_id int, title string, year int, price_tenge double, mileage_km double, description string, condition string, labels string, color string")
    got = {r.ad_id: (r.dup_reasons, r.info_flags) for r in duplicates.reposts(df).collect()}
    assert got[1] == got[2] == ("repost_corroborated", "")
    assert got[3] == got[4] == got[6] == got[7] == ("", "same_title_year_price")
    assert got[5] == ("", "")


def test_photo_pairs(spark):
    hashes = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "a"), (4, None), (5, None)], "ad_id int, phash string")
    pairs = duplicates.same_hash_pairs(hashes)
    assert rows(pairs, "ad_id_a", "ad_id_b") == [(1, 2, 0), (1, 3, 0), (2, 3, 0)]
    cars = spark.createDataFrame([(1, "BMW", "X5", 2010, 100.0), (2, "BMW", "X5", 2011, 110.0), (3, "BMW", "X6", 2010, 100.0)], "ad_id int, brand string, model string, year int, price_tenge double")
    out = duplicates.different_objects(pairs, cars)
    assert [r[:2] for r in rows(out, "ad_id_a", "ad_id_b")] == [(1, 3), (2, 3)]
    assert len(duplicates.different_objects(pairs.limit(0), cars).columns) == 9


def hash_pairs(rows, most):
    """Brute force: all pairs of objects within `most`, the smallest distance."""
    want = {}
    for i, x in rows:
        for j, y in rows:
            if None not in (x, y) and i < j and (d := ((x ^ y) & (1 << 64) - 1).bit_count()) <= most:
                want[i, j] = min(d, want.get((i, j), d))
    return sorted((*k, d) for k, d in want.items())


@pytest.mark.parametrize("width, most", [(32, 8), (64, 8), (32, 0), (64, 1), (5, 4)])
def test_near_photo_pairs(spark, width, most):
    """No pair within the distance is lost, whichever bits differ."""
    rng = random.Random(width + most)
    data = [(1, None), (2, 0), (3, 0), (3, 0), (3, 1), (4, (1 << width) - 1), (5, 0b111 << width - 3)]
    for i in range(10, 60):
        bits = rng.getrandbits(width)
        data += [(i, bits), (i + 100, bits), (i + 200, bits ^ sum(1 << b for b in rng.sample(range(width), min(most, width)))), (i, rng.getrandbits(width))]
    data = [(i, b - (1 << 64) if b is not None and b >> 63 else b) for i, b in data]
    got = duplicates.near_hash_pairs(spark.createDataFrame(data, "ad_id int, bits long"), most, width=width)
    assert rows(got, "ad_id_a", "ad_id_b") == hash_pairs(data, most)


def test_near_photo_pairs_of_the_tables(spark):
    data = [tuple(r) for r in queries._bits(spark, SF, 32).collect()]
    got = rows(queries.photo_near_pairs(spark, SF), "ad_id_a", "ad_id_b")
    assert got == hash_pairs(data, 8) and len(got) > 100


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", "w", 1), (2, "d", "x", 2), (3, "e", None, 1)], "k int, v string, w string, seq int")
    ignore = upserts.upsert_ignore(old, new, ["k"], "seq").select("k", "v", "w")
    assert rows(ignore, "k") == [(1, "a", None), (2, "b", ""), (3, "e", None)]
    assert rows(upserts.upsert_update(old, new, ["k"], ["v"], "seq"), "k") == [(1, "a", None), (2, "d", ""), (3, "e", None)]
    assert rows(upserts.fill_if_null(old, new.where("seq = 2"), ["k"], ["w"], ("w",)), "k") == [(1, "a", None), (2, "b", "x")]
    assert upserts.upsert_ignore(old, new.limit(0), ["k"]).count() == 2


def test_journals(spark):
    j = spark.createDataFrame([(1, 1, "fraud", "c1"), (1, 2, " ", None), (2, 3, None, None), (1, 4, "Legit ", "c4"), (2, 5, "", "z")], "id int, seq int, verdict string, comment string")
    assert rows(upserts.collapse_journal(j, ["id"], "seq", "verdict", "comment"), "id") == [(1, 1, "Legit ", "c4"), (2, 3, None, None)]
    assert rows(upserts.latest_verdict(j, "id", "seq", "verdict"), "id") == [(1, "legit")]
    v = spark.createDataFrame([(1, "fraud", 1), (3, "unknown", 2), (4, "bad", 3)], "id int, verdict string, seq int")
    got = upserts.set_verdicts(j, v, "id", "seq").select("id", "seq", "verdict")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, "fraud"), (2, 3, None), (2, 5, ""), (3, None, "unknown")]


def test_status_predicates(spark):
    data = [("active", 3, None), ("active", 1, None), ("archived", 9, None), (None, 2, 7), (None, 2, 6)]
    df = spark.createDataFrame(data, "s string, seen int, checked int")
    out = df.select(status.needs_check(F.col("s"), F.col("seen"), F.col("checked")))
    assert [r[0] for r in out.collect()] == [True, False, False, True, False]


def test_confusion(spark):
    data = [(True, True, 10, 10), (True, False, 10, 10), (False, True, 1000, 10)]
    df = spark.createDataFrame(data, "f boolean, y boolean, pop int, n int")
    c = F.col
    assert tuple(review.weighted_confusion(df, c("f"), c("y"), c("pop"), c("n")).first()) == (1.0, 1.0, 100.0, 0.0)
    assert tuple(review.weighted_confusion(df, c("f"), c("y"), c("pop"), F.when(c("f"), c("n"))).first()) == (None,) * 4
    prf = review.precision_recall(review.confusion(df, c("f"), c("y"))).first()
    assert (prf.precision, prf.recall, prf.f1) == (0.5, 0.5, 0.5)
    none = review.precision_recall(review.confusion(df.limit(0), c("f"), c("y"))).first()
    assert none.precision is None and none.f1 is None


def test_strata(spark):
    df = spark.range(27).select(F.col("id").alias("ad_id"), (F.col("id") < 3).alias("rule"), (F.col("id") < 7).alias("res"))
    verdicts = spark.createDataFrame([(26,)], "ad_id long")
    q = review.labelling_queue(df, verdicts, "ad_id", F.col("rule"), F.col("res"), cfg=Config(control_sample=5))
    got = {r.sampling_stratum: (r.stratum_population, r.stratum_sample_size) for r in q.collect()}
    assert got == {"rule_positive": (3, 3), "residual_candidate": (4, 4), "random_control": (20, 5)}


def test_prices(spark):
    df = spark.createDataFrame([(i, f"g{i % 25}", float(i)) for i in range(100)], "id int, g string, x double")
    part = pricing.sample_groups(df, "g", 0.5)
    counts = [r[0] for r in part.groupBy("g").count().select("count").collect()]
    assert counts and set(counts) == {4}
    line = spark.range(1001).select(((F.col("id") - 500) / 250).alias("y"), F.lit(0.0).alias("raw"))
    below = pricing.calibrated_floor(line, "y", "raw").where("y < floor_log").count()
    assert abs(below / 1001 - 0.1) <= 1 / 1001
    days = spark.range(120).select("id", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("ts"), (F.col("id") % 50).alias("g"))
    parts = pricing.temporal_holdout(days, "ts", "id", "g").collect()
    test, train = [r for r in parts if r.part == "test"], [r for r in parts if r.part == "train"]
    assert len(test) == 24 and train and not {r.g for r in test} & {r.g for r in train} and max(r.ts for r in train) < min(r.ts for r in test)
    row = pricing.feature_row(spark, 2026, brand="BMW", year=2020, mileage_km=0).first()
    assert (row.age, row.is_mileage_missing, row.model) == (7.0, 0.0, "NA")


def test_leaks_are_refused():
    import pytest

    with pytest.raises(ValueError):
        pricing.check_features(["age", "price_z"])


def test_decisions(spark):
    action = lambda *v: one(spark, S.next_action(*[F.lit(x) for x in v]))
    assert [action(5, 0, True, True), action(5, 3, True, True), action(5, 3, True, False), action(5, 5, False, False), action(5, 4, False, False)] == ["done", "rate_limited", "breaker", "stuck", "continue"]
    assert [one(spark, S.price_band(F.lit(x))) for x in (0.59, 0.6, 0.85, 1.15, 1.4)] == ["far below", "below", "market", "above", "far above"]


def test_phash(spark):
    import random

    from lotwise.functions.phash import phash

    rng = random.Random(1)
    a = [rng.random() * 255 for _ in range(1024)]
    brighter = [x * 0.9 + 10 for x in a]
    b = [rng.random() * 255 for _ in range(1024)]
    got = [r[0] for r in spark.createDataFrame([(a,), (brighter,), (b,), ([1.0],), (None,)], "p array<double>").select(phash(F.col("p"))).collect()]
    assert len(got[0]) == 16 and got[0] == got[1] and got[3] is None and got[4] is None
    assert bin(int(got[0], 16) ^ int(got[2], 16)).count("1") > 12


def test_floor_of_suspicious_rows_is_learned_from_all_clean_ones(spark):
    rows = [(i, "a", 10.0 + i, i % 2, i >= 6) for i in range(8)] + [(8, "b", None, 0, None)]
    df = spark.createDataFrame(rows, "ad_id long, brand string, v double, fold int, bad boolean")
    got = {r.ad_id: (r.fold, r.predicted, r.floor_log) for r in evaluation.floor_for_all(df, "v", [["brand"]], F.col("bad"), 2, F.min).collect()}
    assert got[7][:2] == (-1, 10.0) and got[0][:2] == (0, 11.0) and got[1][:2] == (1, 10.0) and got[8][:2] == (0, 11.0)
    assert len({f - p for _, p, f in got.values()}) == 1 and got[0][2] == 10.0


def test_queue_orders(spark):
    df = spark.createDataFrame([(1, "active", 9, None), (2, "active", 9, 30), (3, "active", 9, 1), (4, "archived", 99, None), (5, None, 3, None), (6, "active", 1, None)], "ad_id long, st string, seen int, checked int")
    c = F.col
    assert [r.ad_id for r in queues.stalest_first(df, c("st"), c("seen"), c("checked"), "ad_id", 5).collect()] == [2, 1, 5]
    rows = spark.createDataFrame([(1, -5.0, "price_anomaly_low", "low"), (2, -9.0, "price_anomaly_low", ""), (3, None, None, "low"), (4, -6.0, "x|price_anomaly_low", "low")], "ad_id long, price_z double, reasons string, iqr_flag string")
    assert [r.ad_id for r in queues.review_order(queues.with_both_low(rows, c("reasons"))).collect()] == [4, 1, 2, 3]
    photos = spark.createDataFrame([(1, 1, "http://a.own.kz/x"), (1, 2, "http://cdn/x"), (2, 1, "http://cdn/y"), (3, 1, None)], "ad_id long, position int, url string")
    flagged = F.col("ad_id") == 3
    assert [(r.ad_id, r.position) for r in queues.download_order(photos, flagged, "own[.]kz", 9).collect()] == [(3, 1), (2, 1), (1, 2), (1, 1)]
    journal = spark.createDataFrame([(1, "legit", 1), (1, "fraud", 2), (1, "", 3), (2, "unknown", 4)], "ad_id long, verdict string, seq long")
    cards = queues.card_rows(rows, rows.select("ad_id", F.lit("o").alias("options_text")).limit(2), photos, journal).collect()
    assert [r.ad_id for r in cards] == [3, 2, 4, 1] and cards[-1].existing_verdict == "fraud" and cards[0].photos == [] and cards[-1].photos == ["http://a.own.kz/x", "http://cdn/x"]


def test_shares_and_errors(spark):
    df = spark.createDataFrame([("a|b", 10.0, 5.0, "x"), ("", 10.0, 20.0, "x"), (None, 4.0, None, None)], "reasons string, price double, floor double, k string")
    assert tuple(evaluation.suspicion_share(df, F.col("reasons")).first()) == (3, 1, pytest.approx(1 / 3))
    assert tuple(evaluation.share_below(df, F.col("price"), F.col("floor")).first()) == (2, 0.5)
    assert {r.k: (r.n, r.mape) for r in evaluation.error_by(df, "k", F.col("price"), F.col("floor")).collect()} == {"x": (2, 0.75), None: (1, None)}
    none = evaluation.suspicion_share(df.limit(0), F.col("reasons")).first()
    assert (none.n, none.share) == (0, None)
    assert one(spark, S.timestamp_of(F.col("t")), t="nonsense") is None and one(spark, S.timestamp_of(F.col("t")), t="2026-07-01 10:00:00").hour == 10


def test_balanced_folds(spark):
    sizes = {"a": 40, "b": 30, "c": 30, "d": 10, "e": 5, None: 5}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = pricing.balanced_folds(df, "g", 3).groupBy("g").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.lo == r.hi for r in got) and {r.g: r.n for r in got} == sizes
    loads = [sum(r.n for r in got if r.lo == f) for f in range(3)]
    assert sorted(loads) == [40, 40, 40]
    assert pricing.balanced_folds(df.where("g in ('a', 'b')"), "g", 5).agg(F.countDistinct("fold")).first()[0] == 2
    many = pricing.balanced_folds(spark.range(4000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("g")), "g", 2)
    assert all(1800 < r["count"] < 2200 for r in many.groupBy("fold").count().collect()) and many.where("g = -1").select("fold").distinct().count() == 1
    with pytest.raises(ValueError):
        pricing.balanced_folds(df.where("g = 'a'"), "g")


def test_split_quantiles_are_exact(spark, monkeypatch):
    """A hot group, ties, null keys and values: the same as the built-in percentile."""
    x = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 5 == 0, 3.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7)
    key = F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 301 != 0, (F.col("id") % 40).cast("string"))
    df = spark.range(60_000).select(key.alias("k"), F.lit(1).alias("j"), x.cast("double").alias("x"))
    for share in (0.0, 0.1, 0.5, 0.973, 1.0):
        want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.lit(share)).alias("q")).collect()}
        got = {r.k: r.q for r in quantiles.group_quantile(df, ["k"], "x", share, large=True, whole=5000).collect()}
        assert got == pytest.approx(want, abs=1e-9) and None in got
    values = sorted(r.x for r in df.where("x is not null").collect())
    for alpha in (0.1, 0.25, 0.9):
        assert pricing.lower_quantile(df, F.col("x"), alpha).first()[0] == values[int(alpha * (len(values) - 1))]
    assert [tuple(r) for r in pricing.lower_quantile(df.limit(0), F.col("x"), 0.1).collect()] == [(None,)]
    tiers = [("both", ["k", "j"]), ("all", ["j"])]
    ends = lambda: (outliers.hierarchical_z(df, "x", tiers), outliers.iqr_fences(df, "x", "k"))
    plain = [sorted(map(str, f.collect())) for f in ends()]
    monkeypatch.setattr(quantiles, "MANY_BYTES", 1000)
    monkeypatch.setattr(quantiles, "WHOLE_GROUP", 5000)
    assert [sorted(map(str, f.collect())) for f in ends()] == plain


@pytest.mark.parametrize("name", ["price_importances", "price_gbt_oof"])
def test_fits_hold_few_rows_in_a_task(spark, monkeypatch, name):
    """A fit gets its rows in parts, though one file holds them."""
    from pyspark.ml import Pipeline

    sizes, fit = [], Pipeline.fit
    monkeypatch.setattr(pricing, "PART_ROWS", 20, raising=False)
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: sizes.append(df.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.sum("count"), F.max("count")).first()) or fit(self, df, *a))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert sizes and all(n > 80 and most < 50 for n, most in sizes)


def test_temporal_evaluation(spark):
    rows = [(i, float(i % 5), "a" if i % 2 else "b", f"2026-01-{1 + i // 40:02d}", 1.0 + i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, brand string, ts string, y double").withColumn("ts", F.to_timestamp("ts"))
    pipe = pricing.price_pipeline(["x"], ["brand"], "y", max_depth=2, max_iter=2)
    args = ("ts", "id", "id", "y", [["brand"]])
    got = {r.method: r for r in evaluation.evaluate_temporal(df, *args, pipe).collect()}
    assert got["baseline"].mape == 0 and got["model"].mape < 0.2 and (got["model"].train_rows, got["model"].test_rows) == (320, 80)
    assert str(got["model"].train_until)[:10] == "2026-01-08" and str(got["model"].test_from)[:10] == "2026-01-09"
    assert evaluation.evaluate_temporal(df.limit(99), *args).count() == 0
    assert evaluation.evaluate_temporal(df.withColumn("ts", F.lit("2026-01-01").cast("timestamp")), *args).count() == 0
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert evaluation.evaluate_temporal(df.mapInArrow(counted, df.schema), *args, pipe).count() == 2 and read.value == 400  # the source, once
    model = pipe.fit(df)
    best = evaluation.importances(model, spark, ["x"], ["brand"], 1).first()
    assert best.feature == "brand" and best.importance > 0.9


def test_gains_and_residuals(spark):
    curve = spark.createDataFrame([(0.25, 0.30), (1.0, 0.218), (0.5, 0.25), (0.75, 0.22)], "share double, mape double")
    r = evaluation.curve_gains(curve).first()
    assert (r.first_gain, r.last_gain, r.is_plateau) == (pytest.approx(5), pytest.approx(0.2), True)
    one_point = evaluation.curve_gains(curve.where("share = 1")).first()
    assert one_point.first_gain is None and one_point.is_plateau is None
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.99, 0.0), (None, 1.0), (0.5, 0.0)], "a double, p double")
    assert sorted((r.bin, r.n) for r in evaluation.residual_histogram(df, "a", "p", 10).collect()) == [(1, 1), (6, 1), (10, 2)]
    assert [(r.bin, r.n) for r in evaluation.residual_histogram(df.limit(1), "a", "p", 10).collect()] == [(1, 1)]


def test_settings(spark):
    from lotwise import config

    assert Config.of(spark) == Config()
    spark.conf.set("spark.lotwise.min_group", "3")
    try:
        assert Config.of(spark).min_group == 3
    finally:
        spark.conf.unset("spark.lotwise.min_group")
    env = {"POSTGRES_USER": "u", "POSTGRES_PASSWORD": "p", "POSTGRES_DB": "d"}
    assert config.database(env) == {"url": "jdbc:postgresql://localhost:5432/d", "user": "u", "password": "p"}
    with pytest.raises(KeyError):
        config.database({})


def test_tables_are_swapped(spark):
    from lotwise.sources import sinks

    sinks.replace_table(spark.range(3), "swapped")
    sinks.swap_table(spark.table("swapped").union(spark.range(3, 5)), "swapped")
    assert spark.table("swapped").count() == 5 and not spark.catalog.tableExists("swapped_staged") and not spark.catalog.tableExists("swapped_replaced")
    spark.sql("ALTER TABLE swapped RENAME TO swapped_replaced")
    sinks.restore_table(spark, "swapped")
    assert spark.table("swapped").count() == 5
    spark.sql("DROP TABLE swapped")


def test_progress(spark):
    at = lambda done, total: one(spark, X.bar(F.lit(done), F.lit(total), 4))
    assert [at(0, 0), at(1, 2), at(4, 4)] == ["────   0%", "██░░  50.0%", "████ 100.0%"]
    assert [one(spark, X.eta_days(F.lit(n), F.lit(10))) for n in (0, 1, 21)] == ["готово", "~1 дн. при 10/день", "~3 дн. при 10/день"]
