"""Walks over documents against plain queues, and rule indexes against trying every pattern."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import detect, discover, parse
from tessera.operators.closure import closure
from tessera.operators.ruleindex import Rule, RuleIndex, needed
from tessera.plans import crawl

SITE = "http://walk.example"
DOCS = "url string, body string"


def read(docs):
    """A body is `done`, or links one a line."""
    links = F.filter(F.split("body", "\n"), lambda x: x != "")
    return docs.select("kind", "url", (F.col("body") == "done").alias("done"), F.substring_index("url", "/", -1).alias("value"), links.alias("next"))


def walked(spark, starts, bodies, **options):
    rows = spark.createDataFrame([("k", s) for s in starts], "kind string, start string")
    out = closure(rows, spark.createDataFrame(list(bodies.items()), DOCS), read, **options).collect()
    return {r.start: (r.found_url, r.level, r.trail, r.needs_url) for r in out}


def queue(start, bodies, limit=None):
    """The same by a queue: (found, level, trail, the first missing document)."""
    todo, seen, missing = [(start, 0, [])], {start}, None
    while todo:
        url, level, trail = todo.pop(0)
        if url not in bodies:
            missing = missing or url
            continue
        trail = [*trail, url.rsplit("/", 1)[1]]
        if bodies[url] == "done":
            return url, level, trail, None
        for link in filter(None, bodies[url].split("\n")):
            target = f"{SITE}/{link}"
            if target not in seen and (limit is None or level < limit):
                seen.add(target)
                todo.append((target, level + 1, trail))
    return None, None, None, missing


@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_chains_of_any_depth_and_a_cycle(spark, depth, monkeypatch):
    rounds = []
    from tessera.sources.shared import Written

    put = Written.put
    monkeypatch.setattr(Written, "put", lambda self, df, name: rounds.append(name) or put(self, df, name))
    bodies = {f"{SITE}/{k}": f"{k + 1}" for k in range(depth)} | {f"{SITE}/{depth}": "done", f"{SITE}/a": "b", f"{SITE}/b": "a"}
    got = walked(spark, [f"{SITE}/0", f"{SITE}/0", f"{SITE}/a", None], bodies)
    assert got == {f"{SITE}/0": (f"{SITE}/{depth}", depth, [str(k) for k in range(depth + 1)], None), f"{SITE}/a": (None, None, None, None), None: (None, None, None, None)}
    assert rounds.count("met") == max(depth, 1) + 2  # one for the start, one for each step of the longest walk (the cycle takes two), one that is empty


def test_random_graphs_against_a_queue(spark):
    rng = random.Random(5)
    names = [str(k) for k in range(60)]
    bodies = {}
    for n in names:
        if rng.random() < 0.9:
            bodies[f"{SITE}/{n}"] = "done" if rng.random() < 0.12 else "\n".join(rng.choice(names) for _ in range(rng.randrange(4)))
    starts = [f"{SITE}/{n}" for n in names]
    assert walked(spark, starts, bodies) == {s: queue(s, bodies) for s in starts}
    got = walked(spark, starts, bodies, limit=1)
    assert {s: r[0] for s, r in got.items()} == {s: queue(s, bodies, 1)[0] for s in starts}


def test_a_hot_document_is_read_once_for_all_walks(spark):
    bodies = {f"{SITE}/{k}": "hub" for k in range(400)} | {f"{SITE}/hub": "end", f"{SITE}/end": "done"}
    got = walked(spark, [f"{SITE}/{k}" for k in range(400)], bodies)
    assert len(got) == 400 and all(r[:2] == (f"{SITE}/end", 2) for r in got.values())


def test_walks_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert closure(spark.createDataFrame([], "kind string, start string"), none, read).count() == 0
    assert walked(spark, [f"{SITE}/x"], {f"{SITE}/y": None}) == {f"{SITE}/x": (None, None, None, f"{SITE}/x")}


def test_links_of_a_start(spark):
    """With from_start links are relative to the start, whatever document names them."""
    bodies = {f"{SITE}/a/0": "in/1", f"{SITE}/a/in/1": "in/2", f"{SITE}/a/in/2": "done"}
    assert walked(spark, [f"{SITE}/a/0"], bodies, from_start=True)[f"{SITE}/a/0"][0] == f"{SITE}/a/in/2"
    assert walked(spark, [f"{SITE}/a/0"], bodies)[f"{SITE}/a/0"][3] == f"{SITE}/a/in/in/2"


def test_scenes_indexes_and_frames_in_a_crawl(spark):
    scene = '<krpano><image><cube url="p_%v.jpg" multires="64,640x640"/></image></krpano>'
    pff = 'reply_data=<PFF WIDTH="300" HEIGHT="200" TILESIZE="100" NUMTILES="6" HEADERSIZE="20"/>'
    held = {
        f"{SITE}/p/": "embedpano({xml: 'one.xml'})", f"{SITE}/p/one.xml": '<krpano><include url="no.xml"/><include url="in/two.xml"/></krpano>', f"{SITE}/p/no.xml": "<krpano/>",
        f"{SITE}/p/in/two.xml": '<krpano><include url="in/three.xml"/></krpano>', f"{SITE}/p/in/three.xml": scene, f"{SITE}/q/": "embedpano({xml: 'q.xml'})", f"{SITE}/q/q.xml": "<krpano/>",
        f"{SITE}/one?file=/q.pff&requestType=1": pff, f"{SITE}/one?file=/q.pff&requestType=2&begin=1080&end=1128": "reply_data=5000," + "".join(f"{n:9d}" for n in (40, 95, 130, 200, 260, 333)),
        f"{SITE}/two?file=/r.pff&requestType=1": pff,
        f"{SITE}/z": "type: 'zoomifytileservice' <iframe src='z1'>", f"{SITE}/z1": "<iframe src='deep/z2'>", f"{SITE}/deep/z2": "zoomifyImagePath=im&", f"{SITE}/deep/im/ImageProperties.xml": '<IMAGE_PROPERTIES WIDTH="700" HEIGHT="500" NUMTILES="12" TILESIZE="200"/>',
        f"{SITE}/r": "showImage(1) <iframe src='r1'>", f"{SITE}/r1": "<iframe src='r'>", f"{SITE}/t.xml": '<Image TileSize="9" Overlap="0" Format="png"><Size Width="9" Height="9"/></Image>',
    }
    asked = [f"{SITE}/p/", f"{SITE}/q/", f"{SITE}/one?file=/q.pff&requestType=0", f"{SITE}/two?file=/r.pff&requestType=1", f"{SITE}/z", f"{SITE}/r", f"{SITE}/t_files/3/0_0.jpg", f"{SITE}/p/"]
    formats = ["krpano", "Zoomify PFF", "Zoomify", "Seadragon"]
    requests = spark.createDataFrame(list(enumerate(asked)), "request_id long, url string")
    out = crawl.describe(requests, spark.createDataFrame(list(held.items()), DOCS), formats)
    rows = {r.request_id: r for r in out.collect()}
    assert len(rows) == 8 and {k: r.failed_at for k, r in rows.items()} == {0: None, 1: "parse", 2: None, 3: "fetch", 4: None, 5: "discover", 6: None, 7: None}
    assert (rows[0].width, rows[0].origin) == (640, f"{SITE}/p/one.xml") and rows[2].offsets[:2] == [5040, 5095] and rows[4].width == 700 and rows[6].width == 9
    assert rows[3].needs_url == f"{SITE}/two?file=/r.pff&requestType=2&begin=1080&end=1128" and "lead back" in rows[5].error
    tiles = {r.request_id: r.url for r in crawl.tiles(out, formats).filter("tile_index = 0").collect()}
    assert tiles[0] == tiles[7] == f"{SITE}/p/p_1.jpg" and tiles[2].endswith("&begin=1128&end=5040") and tiles[4].startswith(f"{SITE}/deep/im/TileGroup0/")


def test_included_scenes_and_levels(spark):
    body = '<krpano><include url="a.xml"/><image tilesize="100"><level tiledimagewidth="300" tiledimageheight="200"><front url="x"/></level></image><include url="b.xml"/></krpano>'
    r = spark.range(1).select(parse.scene_includes(F.lit(body)).alias("i"), parse.scene_levels(F.lit(body)).alias("v"), F.size(parse.scene_levels(F.lit("<krpano/>"))).alias("n")).first()
    assert r.i == ["a.xml", "b.xml"] and r.v[0].width == 300 and r.n == 0


def test_a_page_of_prose_is_searched_in_no_time(spark):
    """Patterns take time in proportion to a page, not to its square."""
    words = " ".join(f"word{k} over the dzi lazy" for k in range(45_000))
    pages = {"prose": words, "calls": "Seadragon.embed(" * 20_000, "quotes": "Seadragon.embed(" + '"a.xml" ' * 60_000, "frames": "<iframe " * 60_000, "base64": "src=data:image/png;base64," + "ab/+" * 250_000}
    docs = spark.createDataFrame([(f"{SITE}/{k}", v) for k, v in pages.items()], DOCS).cache()
    requests = spark.createDataFrame([(i, f"{SITE}/{k}", "Seadragon") for i, k in enumerate(pages)], "request_id long, url string, format string")
    docs.count()
    discover.discover(requests.limit(0), docs, ["Seadragon"]).collect()  # the first plan takes its time
    start = time.time()
    found = discover.discover(requests, docs, ["Seadragon"]).collect()
    detected = docs.select(detect.by_content(F.col("body")).alias("f")).collect()
    assert len(found) == 5 and time.time() - start < 15
    assert [r.f for r in detected] == ["Seadragon", None, "Seadragon", None, None]


@pytest.mark.parametrize("body,want", [
    ("see 'x y' (old/leaf.dzi) and b.xml", f"{SITE}/s/old/leaf.dzi"), ("a.xml.b.dzi.c 'z.xml'", f"{SITE}/s/a.xml.b.dzi"), ("'.xml' <.dzi> \"k.XML\"", f"{SITE}/s/k.XML"),
    ("Seadragon.embed('1', 'a.xml', \"b.dzi?x=1\", 7) 'c.dzi'", f"{SITE}/s/b.dzi?x=1"), ("Seadragon.embed(1) Seadragon.embed('q.xml')", f"{SITE}/s/q.xml"), ('{"dzi": "deep/k"}', f"{SITE}/s/deep/k"), ("nothing", f"{SITE}/s/p"),
])
def test_deep_zoom_documents_named_in_pages(spark, body, want):
    requests = spark.createDataFrame([(1, f"{SITE}/s/p", "Seadragon")], "request_id long, url string, format string")
    assert discover.discover(requests, spark.createDataFrame([(f"{SITE}/s/p", body)], DOCS), ["Seadragon"]).first().meta_url == want


# Rule indexes


def test_what_patterns_need():
    assert needed(r"zoom(?:\.it|hub.net)/.*\.js") == [("zoom",), (".it", "hub"), (".js",)]
    assert needed(r"(?i)WMTS\b") == [("wmts",)] and needed(r"(abc)?d*[xyz]") == [] and needed(r"(?:abc|x*)") == [] and needed(r"(unclosed") == []
    assert needed(r"(?!never)once(?=also)") == [("also",), ("once",)] and needed(r"a{0,3}bcd{2}") == []


def test_the_index_answers_as_all_patterns_do(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 6))) for _ in range(700)]
    rules = [Rule(k, f"f{k % 9}", rng.choice([rf"\b{n}\b", rf"(?i){n}[0-9]+", rf"{n}.*{names[k - 1]}", rf"(?:{n}|{names[k - 2]}x)\s", rf"[{n}]{{9}}!"])) for k, n in enumerate(names)]
    texts = [" ".join(rng.choice([rng.choice(names), rng.choice(names).upper() + "7", "zz", "K"]) for _ in range(rng.randrange(25))) + rng.choice(["", "!", "\n"]) for _ in range(300)] + [None, ""]
    got = detect.by_index(spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id long, body string, format string").drop("format"), RuleIndex(rules)).orderBy("id").collect()
    for r, t in zip(got, texts, strict=True):
        want = next((x for x in rules if t is not None and re.search(x.pattern, t)), None)
        assert (r.rule, r.format) == ((want.number, want.format) if want else (None, None)), t


def test_the_index_of_detections_own_rules(spark):
    texts = ["Seadragon.embed('x', 'a.dzi')", "<micr-io id='bZyXw'>", "http://a.example/i/full/full/0/native.jpg", "krpano", "server?type=1&image=2", "plain", "flashVars x playlist=k.xml", '"shortId": "Pq7Rs" philamuseum', None]
    pages = spark.createDataFrame([(t,) for t in texts], "body string")
    index = RuleIndex(detect.as_rules(1))
    got = detect.by_index(pages, index).select("body", "format", detect.by_content(F.col("body")).alias("plain")).collect()
    assert all(r.format == r.plain for r in got) and sum(r.format is not None for r in got) == 7
    assert detect.by_index(pages, RuleIndex([])).filter("format is not null").count() == 0
