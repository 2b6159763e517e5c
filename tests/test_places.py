"""Place functions on literal cases."""

import math
import random

from pyspark.sql import functions as F

from wayfolio.functions import places as P
from wayfolio.plans.ingest import parse_elements
from wayfolio.sources.json_rows import bindings_to_places, entity_metadata, explode_book_json, read_bindings, read_geo_elements


def tagged(column, fn, *tag_rows):
    return column(fn, *[(t,) for t in tag_rows], schema="tags map<string,string>")


def test_categories(column):
    raw = ["muslim", "Christian", "church", "Place of worship", "other", "chinese_folk", "Cao Dai", "", None]
    assert column(P.normalize_category, *raw) == [
        "Islam", "Christianity", "Christianity", "Sacred place", "Other", "Chinese Folk", "Cao Dai", "Sacred place", "Sacred place",
    ]
    assert column(P.strict_category, "Bahai", "taoist", None) == ["Bahai Faith", None, None]
    assert tagged(column, P.category_from_tags, {"religion": "sikh"}, {"building": "church"}, {"historic": "monastery"}, {}) == [
        "Sikhism", "Christianity", "Place of worship", "Place of worship",
    ]
    assert column(lambda v: F.array_sort(P.category_terms(v)), "hindu", None) == [
        ["Hinduism", "hindu", "hinduism"], ["Place of worship", "Sacred place", "place_of_worship"],
    ]
    style = column(P.marker_style, "mosque", "Cao Dai", None)
    assert [(s.label, s.key, s.symbol, s.class_name) for s in style] == [
        ("Islam", "islam", "☪", "temple-marker--islam"), ("Cao Dai", "other", "✦", "temple-marker--other"),
        ("Sacred place", "sacred-place", "•", "temple-marker--sacred-place"),
    ]


def test_similar_names(column):
    assert column(P.similar_name_key, "Green Heights school mosque", "St Prophet Elijah", "The  Saint-Anne", "Храм", "x" * 60) == [
        "greenheightsschoolmosque", "prophetelijah", "anne", "", "x" * 42,
    ]
    assert column(lambda v: P.similar_name_key(v, unicode=True), "Храм 1") == ["храм1"]


def test_generic_names(column):
    rows = [("Temple", {}), ("Temple", {"wikidata": "Q1"}), ("Temple", {"website": ""}), ("Blue Temple", {})]
    assert column(lambda n, t: P.skip_generic(n, t), *rows, schema="n string, t map<string,string>") == [True, False, True, False]


def test_tag_chains(column):
    rows = [{"name:en": " A  b "}, {"name": "", "official_name": "O"}, {"name": "  "}, {}]
    assert tagged(column, P.element_name, *rows) == ["A b", "O", None, None]
    address = lambda t: P.compose_address(t, F.lit("Town"), F.lit("Land"))
    assert tagged(column, address, {"addr:full": "Whole 1"}, {"addr:housenumber": "5", "addr:street": "High St", "addr:postcode": "99"}, {}) == [
        "Whole 1", "5 High St, Town, 99, Land", "Town, Land",
    ]


def test_urls(column):
    assert column(P.safe_url, " HTTPS://a.example ", "ftp://b", None) == ["HTTPS://a.example", None, None]
    base = "https://commons.wikimedia.org/wiki/Special:FilePath/"
    rows = [{"image": "https://i/a.jpg"}, {"image": "File:x y(1)!'~*é.jpg"}, {"image": "File:Category:Z"}, {"wikimedia_commons": "image:z.png"},
            {"wikimedia_commons": "Category:Halls"}, {}]
    assert tagged(column, P.image_url, *rows) == [
        "https://i/a.jpg", base + "x%20y(1)!'~*%C3%A9.jpg?width=1200", None, base + "z.png?width=1200", None, None,
    ]
    assert tagged(column, P.entity_id, {"wikidata": " q12 "}, {"wikidata": "X7"}, {"brand:wikidata": "Q3"}, {}) == ["Q12", None, "Q3", None]
    assert column(lambda a, b: P.directions_url(a, b), (1.5, 2.0), (None, 2.0), schema="a double, b double") == [
        "https://www.google.com/maps/dir/?api=1&destination=1.5,2", None,
    ]


def test_points_and_cells(column):
    points = column(P.parse_point, "Point(23.3 42.7)", "point(-1 2)", "Point(bad)", "POINT 1 2", None)
    assert [p and (p.latitude, p.longitude) for p in points] == [(42.7, 23.3), (2.0, -1.0), None, None, None]
    assert column(lambda v: P.coord_cell(v, 5), 1.000005, -1.000005, 0.0, None, schema="v double") == [100001, -100001, 0, None]
    assert column(lambda a, b: P.valid_coords(a, b), ("0", "0"), ("", "1"), ("x", "1"), (None, "1"), schema="a string, b string") == [True, False, False, False]
    assert column(lambda a, b: P.valid_coords(a, b, ranged=True), (91.0, 0.0), (-90.0, 180.0), (float("nan"), 1.0), schema="a double, b double") == [False, True, False]


def test_distance(column):
    rng = random.Random(3)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)]

    def plain(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(x)))

    got = column(lambda a, b, c, d: P.haversine_km(a, b, c, d), *rows, schema="a double, b double, c double, d double")
    assert all(abs(g - plain(*r)) < 1e-6 * max(1, g) for g, r in zip(got, rows))


def test_name_similarity(column):
    rows = [("Blue Hall", ["blue  hall"]), ("Blue Hall", ["The Blue Hall"]), ("Blue", ["Red"]), ("", ["x"]), ("Blue", [])]
    assert column(lambda n, a: P.name_similarity(n, a), *rows, schema="n string, a array<string>") == [3, 2, 0, 0, 0]


def test_quality_score(spark):
    cols = "name string, image_url string, description string, website_url string, denomination string, city string, address string, religion string, latitude double, longitude double"
    df = spark.createDataFrame([("a", *["x"] * 7, 0.0, 0.0), ("b", *[" "] * 7, 1.0, None), ("c", "i", None, "w", None, "c", None, None, 1.0, 1.0)], cols)
    assert [r[0] for r in df.select(P.quality_score()).collect()] == [12, 0, 7]


def test_elements(spark):
    rows = [
        (1, 0, '{"type":"node","id":1,"lat":1.5,"lon":2.5,"tags":{"name":"A","religion":"muslim","wikidata":"Q5"}}'),
        (2, 0, '{"type":"way","id":2,"center":{"lat":0,"lon":0},"tags":{"name:en":"B","building":"church"}}'),
        (3, 0, '{"type":"node","id":3,"tags":{"name":"C"}}'),
        (4, 0, '{"type":"node","id":4,"lat":1,"lon":1,"tags":{"name":"Temple"}}'),
        (5, 0, '{"type":"node","id":5,"lat":1,"lon":1,"tags":{"name":"Temple","website":"http://t"}}'),
        (6, 0, '{"type":"node","id":6,"lat":1,"lon":1}'),
    ]
    elements = read_geo_elements(spark.createDataFrame(rows, "arrival long, target_id int, json string"))
    targets = spark.createDataFrame([(0, "Sofia", "Bulgaria")], "target_id int, name string, country string")
    out = {r.arrival: r for r in parse_elements(elements, targets).collect()}
    assert [out[i].outcome for i in range(1, 7)] == ["candidate", "candidate", "no_coordinates", "generic", "candidate", "unnamed"]
    assert (out[1].city, out[1].country, out[1].religion, out[1].external_id, out[1].wikidata_id) == ("Sofia", "Bulgaria", "Islam", "node/1", "Q5")
    assert out[2].religion == "Christianity" and out[2].latitude == 0.0 and out[2].type == "church"
    assert out[2].description == "OpenStreetMap sacred place: church Christianity in Sofia, Bulgaria. OSM way/2."
    listed = spark.createDataFrame([("x", '{"elements":[{"type":"node","id":1,"lat":1,"lon":2},{"type":"way","id":2}]}')], "k string, json string")
    assert read_geo_elements(listed, listed=True).count() == 2


def test_bindings_entities_books(spark):
    rows = [(1, '{"place":{"value":"http://e/Q1"},"placeLabel":{"value":"P"},"coord":{"value":"Point(23.3 42.7)"},"cityLabel":{"value":"S"},"religion":{"value":"Islam"}}'),
            (2, '{"placeLabel":{"value":"P"},"coord":{"value":"Point(x)"}}')]
    places = bindings_to_places(read_bindings(spark.createDataFrame(rows, "arrival long, json string"))).collect()
    assert [(p.name, p.latitude, p.description, p.website_url) for p in places] == [("P", 42.7, "Islam in sacred place in S", "http://e/Q1")]
    entity = spark.createDataFrame([("Q1", '{"descriptions":{"en":{"value":"D"}},"claims":{"P18":[{"mainsnak":{"datavalue":{"value":"a b.jpg"}}}]}}'), ("Q2", '{"claims":{}}')], "qid string, json string")
    assert [(r.description, r.image_url, r.website_url) for r in entity_metadata(entity).orderBy("qid").collect()] == [
        ("D", "https://commons.wikimedia.org/wiki/Special:FilePath/a%20b.jpg?width=1200", None), (None, None, None),
    ]
    book = spark.createDataFrame([("B", '{"chapters":[{"chapter":"1","verses":[{"verse":"1","text":"x"}]},{"chapter":"2","verses":[{"verse":"1","text":"y"},{"verse":"2","text":"z"}]}]}')], "book string, json string")
    assert [tuple(r) for r in explode_book_json(book).collect()] == [("B", 1, 1, "x"), ("B", 2, 1, "y"), ("B", 2, 2, "z")]
