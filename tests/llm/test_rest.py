"""Pages, vectors, licences, mixing and packing."""

import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mealgrid.llm import hamming, html, licenses, mixing, packing, warc
from mealgrid.llm.queries import QUERIES
from tests.llm.cases import SF, TEXTS, awkward, crc, empty, rows, targets, words

PAGES = "page_id bigint, url string, html string, host string, subtrees string, record_id string"


def pages(spark, items):
    return spark.createDataFrame([(i, u, h, "z", "z", None) for i, u, h in items], PAGES).repartition(2)


# Mixing


def test_mix_of_the_whole_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_mix_sources"](spark, SF).collect()
    sizes = Counter()
    for r in docs.values():
        sizes[r.source] += len(words(r.text))
    want, near = targets(sizes), Counter()
    for r in got:
        d = docs[r.doc_id]
        assert (r.size, r.source_size) == (len(words(d.text)), sizes[d.source])
        assert r.target == pytest.approx(want[d.source]) and 0 <= r.taken <= 2 * r.size
        near[d.source] += r.taken
    longest = max(r.size for r in got)
    assert len(got) == len(docs) and all(abs(near[s] - want[s]) <= longest for s in sizes)
    assert rows(QUERIES["op3_mix_sources"](spark, SF)) == sorted(map(tuple, got), key=repr)


def test_mix_of_awkward_rows(spark):
    got = mixing.taken(awkward(spark)).collect()
    assert len(got) == len(TEXTS)
    sizes = Counter()
    for _, t, _, s in TEXTS:
        sizes[s] += len(words(t))
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in targets(sizes).values()})
    assert mixing.taken(empty(spark)).collect() == []
    out = mixing.repeated(awkward(spark))
    assert out.columns == awkward(spark).columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in got)


def test_hot_source_in_many_blocks_balances(spark):
    units = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, "hot").alias("source"), (F.col("id") * 7919 % 400 + 1).alias("size"))
    out = mixing.mix(units, block=64).groupBy("source").agg(
        F.sum(F.col("times") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.sum("times").alias("n"), F.count("*").alias("rows"), F.first("source_size").alias("all")
    )
    for r in out.collect():
        assert abs(r.taken - r.target) <= 400
        assert abs(r.n - r.rows * r.target / r["all"]) <= 3


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 60)
    p = rng.random(60)
    draws = [mixing.fly(p, sizes, np.random.default_rng(s), False) for s in range(800)]
    for d in draws[:50]:
        assert ((d > 1e-9) & (d < 1 - 1e-9)).sum() <= 2
        assert d.sum() == pytest.approx(p.sum()) and d @ sizes == pytest.approx(p @ sizes)
    assert np.abs(np.mean(draws, axis=0) - p).max() < 0.1


# Packing


def test_packing_of_the_whole_table(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(QUERIES["op6_pack_sequences"](spark, SF).collect(), ids)


def check_packing(got, ids):
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.start == 2048 * r.piece
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append(r.length)
    assert {i: sum(p) for i, p in parts.items()} == {i: len(x) for i, x in ids.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= total / 2048 * 1.05 + 1


def test_words_are_tokenized_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    cache = packing._Words(packing.tokenizer_path())
    for text in ("It's we'll I'd DON'T x'sx 'sS", "a\tb\r\nc  d", "É ñandú ŐŸ ½ ²³ µ ª ß İ ſ", "á e‍b 你好 😀!!", "\x1c\x85\xa0x", "<|endoftext|> $$$ 12.5%", ""):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert cache.ids(text) == struct.pack(f"<{len(want)}I", *want), text


def test_added_tokens_in_texts_are_read_as_the_file_says(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["One<|endoftext|>two", "<|startoftext|> three", "<|ENDOFTEXT|> four", "<|endoftext", "five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(docs).collect()}
    assert got == {i: (len(x), crc(x)) for i, x in ids.items()}


def test_packing_of_awkward_rows(spark):
    got = packing.packed(packing.pieces(awkward(spark)))
    pieces = Counter((r.doc_id, r.piece) for r in got.collect())
    assert pieces[(1, 0)] == 2 and pieces[(None, 0)] == 2 and pieces[(7, 1)] == 1
    assert packing.packed(packing.pieces(empty(spark))).collect() == []


def test_best_two_fit_replaces_the_smallest():
    # Greedy fills 6 + 3 and leaves 1; 3 is replaced by 2 + 2.
    bins = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert [sorted([6, 3, 2, 2][i] for i in b) for b in bins] == [[2, 2, 6], [3]]
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 3000)
    bins = packing.best_two_fit(lengths)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sum(lengths[b]) <= 2048 for b in bins)
    assert len(bins) <= 1.1 * lengths.sum() / 2048


# Pages


def test_main_text(spark):
    nav = "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
    article = "<article><header><h1>Title &amp; more</h1></header><p>One<br>\n  two<p><b>Three<p>Four &lt;5<table><tr><td>x<td>y</table>"
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><header>Site</header>" + nav
        + "<div class='cookie-notice'>We use cookies</div>" + article
        + "<aside>Side</aside><form>Mail <input></form><script>var t='</p>'</script><section id=comments><p>First!</p></section></article>"
        + "<div class='ad'>Buy</div><footer>&copy;</footer></body></html>"
    )
    got = html.extract(pages(spark, [(1, "http://h.example/1", page), (2, None, None), (3, "x", ""), (3, "x", ""), (None, "http://h.example", "<p>plain"), (5, "http://e.example", "a < b <b>c</b>")]))
    by = {r.page_id: r for r in got.collect()}
    assert by[1].text == "Title & more\nOne two\nThree\nFour <5\nx\ny" and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and by[None].text == "plain" and by[5].text == "a < b c"
    assert got.count() == 6


def test_names_tell_what_is_no_article():
    page = (
        "<body class='has-sidebar'><div class='site-header'>Site</div><div class='layout with-sidebar'><main>"
        "<article class='post no-comments'><div class='entry-header'><h1>Title</h1></div><p>Text<span class=ad>Buy <b>now</b></span> goes on</p>"
        "<div class='post-comments-area'><article class='comment'>Nice</article></div><ul class='share-list'><li>Tweet</li></ul></article>"
        "<article class='comment depth-1'>Also nice</article></main></div><div role='navigation'>Home</div></body>"
    )
    assert html.parsed(page)[0] == ["Title", "Text goes on"]
    assert html.parsed("<p>a<span hidden>x<p>b<i>c</i> d<a class=ad>y</p>e<div>f</div>")[0] == ["a", "bc d", "e", "f"]


def test_recurring_subtrees_go_and_copies_stay(spark):
    box = "<div><p>About this site</p><p>Read on</p></div>"
    items = [(i, "http://h.example/x", f"<html><body>{box}<div><p>Story {i}</p></div></body></html>") for i in range(40)]
    items += [(100 + i, "http://h.example/y", f"<html><body>{box}<div><p>The same story</p></div></body></html>") for i in range(40)]
    items += [(200, "http://other.example/", f"<html><body>{box}</body></html>")]
    items += [(300 + i, "http://h.example/z", f"<html><body><nav>{i}</nav><article><p>Shared</p><p>news</p></article></body></html>") for i in range(30)]
    by = {r.page_id: r.text for r in html.extract(pages(spark, items)).collect()}
    assert all(by[i] == f"Story {i}" for i in range(40))
    # Exact copies are one page, and what stands in a main element is never a template.
    assert all(by[100 + i] == "The same story" for i in range(40)) and by[200] == "About this site\nRead on"
    assert all(by[300 + i] == "Shared\nnews" for i in range(30))


def test_an_article_survives_what_it_stands_in():
    article = "<article class='post comments-open'><h1>Title</h1><p title='the hidden truth'>Text of it</p></article>"
    for start, end in [
        ("<form>", "</form>"), ("<div class='sidebar-left'>", "</div>"), ("<div class='comments-enabled'>", "</div>"),
        ("<div class='has-fixed-header'>", "</div>"), ("<div class='related-layout'><form>", "</form></div>"), ("<div class='header-top'>", "</div>"),
        ("<span class='share'>", "</span>"),
    ]:
        page = f"<body>{start}<p>Subscribe</p>{article}<ul><li>Menu</li></ul>{end}</body>"
        assert html.parsed(page)[0] == ["Title", "Text of it"], start
        # Also beside much other text.
        assert html.parsed(page + f"<div>{'Other text. ' * 20}</div>")[0][:2] == ["Title", "Text of it"], start
    # Articles in a side column do not replace the text, nor do comments after a main element.
    assert html.parsed("<div><p>The long text of the page</p></div><aside><article>Teaser</article></aside>")[0] == ["The long text of the page"]
    assert html.parsed("<main>Text</main><section id=comments><article>Nice</article></section>")[0] == ["Text"]
    assert html.parsed("<article></article><p>Text</p>")[0] == ["Text"]
    assert html.parsed("<p hidden>a<p aria-hidden='true'>b<p style='display: none'>c<p data-x='hidden'>d")[0] == ["d"]


def test_embedded_elements_end_where_they_end():
    for start in ("<svg class='i'/>", "<select><option>", "<object data='x'>", "<iframe src='x'>", "<noscript>", "<math/>", "<textarea>"):
        page = f"<body><div>{start}</div><article>Text</article><div><svg><path d='x'/>s</svg><select><option>o</select><iframe>f</iframe></div></body>"
        assert html.parsed(page)[0] == ["Text"], start
    page = "<p>One <svg><svg>a</svg><text>b</text></svg>two <object>c</object>three <template><article>d</article></template>four</p>"
    assert html.parsed(page)[0] == ["One two three four"]
    assert html.parsed("<article>If <math><mrow><mi>x</mi><mo>&lt;</mo><mn>2</mn></mrow></math> then</article>")[0] == ["If x<2 then"]
    assert html.parsed("a<script>b<p>c")[0] == ["a"]


def test_recurring_subtrees_inside_the_main_element_go(spark):
    box = "<div><p>Tell your friends</p><p>Join our list</p></div>"
    items = [(i, "http://h.example/x", f"<main><article><p>Story {i} is told here</p>{box}<p>And {i} ends</p></article></main>") for i in range(20)]
    # Versions of one article, and copies of it under changing menus, keep their text.
    long = "".join(f"<p>Paragraph {k} of a long article with many words in it</p>" for k in range(8))
    items += [(100 + i, "http://h.example/y", f"<article>{long}<p>Edit {i}</p></article>") for i in range(20)]
    items += [(200 + i, "http://h.example/z", f"<nav>{i}</nav><article><p>Shared</p>{box}<p>news</p></article>") for i in range(20)]
    by = {r.page_id: r.text for r in html.extract(pages(spark, items)).collect()}
    assert all(by[i] == f"Story {i} is told here\nAnd {i} ends" for i in range(20))
    assert all(by[100 + i].count("Paragraph") == 8 and by[100 + i].endswith(f"Edit {i}") for i in range(20))
    assert all(by[200 + i] == "Shared\nnews" for i in range(20))


def test_templates_of_a_small_share_of_a_host_go(spark):
    items = [(i, "http://h.example/x", f"<div><p>Story number {i} is told here</p></div><div class=x><p>Offer {i % 25}</p></div>") for i in range(800)]
    long = "".join(f"<p>Paragraph {k} of a long article with many words in it</p>" for k in range(8))
    items += [(1000 + i, "http://h.example/y", f"<div>{long}</div><p>Edit {i}</p>") for i in range(12)]
    by = {r.page_id: r.text for r in html.extract(pages(spark, items)).collect()}
    assert all(by[i] == f"Story number {i} is told here" for i in range(800))
    assert all(by[1000 + i].count("Paragraph") == 8 for i in range(12))


def test_pages_of_the_table_hold_their_articles(spark):
    import re

    got = {r.page_id: r.text for r in QUERIES["op7_html_main_text"](spark, SF).collect()}
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert set(got) == set(source)
    for i, page in source.items():
        inner = page[page.index("<article>") : page.index("<footer>") if "<footer>" in page else None]
        blocks = [re.sub(r"\s+", " ", html.entities.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|article|footer)>", inner)]
        assert got[i] == "\n".join(b for b in blocks if b), i


def test_derivatives(spark):
    source = pages(spark, [(1, "http://a.example/", "<p>A &amp; B</p><script>x</script><p>C"), (2, None, None), (2, None, None)])
    got = warc.derivatives(warc.as_responses(source)).collect()
    assert len(got) == 6
    one = {r.record_type: r for r in got if r.page_id == 1}
    assert one["conversion"].block == "A & B\nC"
    assert one["metadata"].refers_to == one["conversion"].refers_to and one["conversion"].record_id in one["metadata"].block
    assert "HTTP/1.1 200 OK" in one["metadata"].block and one["metadata"].payload_digest in one["metadata"].block
    for r in got:
        assert f"Content-Length: {len(r.block.encode())}\r\n" in r.header and r.n_bytes == len(r.block.encode())
    bare = spark.createDataFrame([(None, None, None, None, None, None, "keep")], "record_id string, target_uri string, date string, http string, payload string, payload_digest string, header string")
    assert all(r.refers_to.startswith("<urn:uuid:") for r in warc.derivatives(bare).collect())
    assert warc.derivatives(bare.limit(0)).collect() == []


def test_plain_text_decodes_every_reference(spark):
    page = "<p>caf&eacute; &mdash; it&#8217;s &#x2014;&nbsp;&#160;x &amp;eacute; &amp;lt; &hearts; &unknown; &amp &lt;b&gt; a&NotEqualTilde;b"
    got = warc.derivatives(warc.as_responses(pages(spark, [(1, "http://a.example/", page)]))).where("record_type = 'conversion'").collect()
    assert [r.block for r in got] == ["café — it’s — x &eacute; &lt; ♥ &unknown; &amp <b> a\u2242\u0338b"]


def test_written_records_are_read_back(spark, tmp_path):
    import gzip

    records = warc.derivatives(warc.as_responses(pages(spark, [(1, "http://a.example/", "<p>é</p>")]))).coalesce(1)
    warc.write(records, str(tmp_path / "out"))
    text = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "out").glob("*.gz"))).decode()
    assert text == "".join(f"{r.header}\r\n{r.block}\r\n\r\n" for r in records.collect())


# Vectors


def brute(vectors, k):
    out = []
    for q, x in vectors:
        if q % 100 == 0:
            near = sorted((int((x != y).sum()), i) for i, y in vectors if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out, key=repr)


def test_neighbours_of_the_whole_table(spark):
    vectors = [(r.vec_id, np.array(r.embedding) > 0) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows(QUERIES["op4_hamming_top_k"](spark, SF)) == brute(vectors, 10)


def test_neighbours_among_equal_codes_and_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    made = [(i, rng.normal(size=64) if i % 3 else np.ones(64)) for i in range(400)]
    schema = "vec_id bigint, embedding array<float>, code string, id string"
    items = [(i, [float(v) for v in x], "z", "z") for i, x in made] + [(None, [1.0], "z", "z"), (900, None, "z", "z")]
    codes = hamming.codes(spark.createDataFrame(items, schema))
    got = hamming.nearest(codes, codes.where("id % 100 = 0"), k=5)
    assert rows(got) == brute([(i, x > 0) for i, x in made], 5)
    none = hamming.codes(spark.createDataFrame([], schema))
    assert hamming.nearest(none, none).collect() == []


@pytest.mark.parametrize("resident", [0, hamming.RESIDENT])
def test_neighbours_of_repeated_rows_and_few_codes(spark, resident):
    """Each id is several rows of several codes; 12-bit embeddings fill up to 16 bits; fewer rows than k are all found."""
    rng = np.random.default_rng(5)
    made = [(i % 70, rng.normal(size=12).round(1)) for i in range(200)] + [(200, np.ones(12))] * 15
    for few in (made, made[:6]):
        codes = hamming.codes(spark.createDataFrame([(i, [float(v) for v in x]) for i, x in few], "vec_id bigint, embedding array<double>"))
        bits = [(i, np.append(x > 0, [False] * 4)) for i, x in few]
        asked_code = {i: min((b.tolist() for j, b in bits if j == i)) for i, _ in few if i % 5 == 0}
        want = []
        for q, own in asked_code.items():
            away = sorted((int((np.array(own) != b).sum()), i) for i, b in bits if i != q)[:7]
            want += [(q, r + 1, i, d) for r, (d, i) in enumerate(away)]
        got = hamming.nearest(codes, codes.where("id % 5 = 0"), k=7, resident=resident).collect()
        assert sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in got) == sorted(want)


def test_clustered_codes_end_their_search_early(spark):
    """Of 20,000 codes in clusters, the rounds that are needed meet a small part."""
    rng = np.random.default_rng(6)
    centers = rng.integers(0, 2, (400, 64))
    bits = centers[np.arange(20_000) % 400] ^ (rng.random((20_000, 64)) < 0.03)
    codes = hamming.stage(spark.createDataFrame([(i, bytes(np.packbits(b))) for i, b in enumerate(bits)], "id bigint, code binary"))
    got = hamming.nearest(codes, codes.where("id % 1000 = 0")).collect()
    for q in range(0, 20_000, 1000):
        away = sorted((int(d), i) for i, d in enumerate((bits != bits[q]).sum(axis=1)) if i != q)[:10]
        assert sorted((r["rank"], r.distance, r.neighbor_id) for r in got if r.query_id == q) == [(r + 1, *x) for r, x in enumerate(away)]
    cuts = hamming.segments(16, 20_000)
    asked = codes.where("id % 1000 = 0").select(F.col("id").alias("query_id"), hamming._values(cuts).alias("own"), F.lit(None).cast("int").alias("far"))
    values = codes.select(hamming._values(cuts).alias("other"), F.array(F.struct("id", F.lit(1).alias("n"))).alias("members"))
    index = values.select(F.posexplode("other").alias("j", "value"), "other", "members")
    reached = sum(hamming.met(hamming.probes(asked, [4 * d for _, d in cuts], r), index, r).count() for r in (0, 1))
    assert reached < 0.1 * 20 * 20_000


# Licences


def test_licences_of_awkward_rows(spark):
    got = {r.doc_id: r for r in licenses.scan(awkward(spark)).where("doc_id is not null").collect()}
    assert got[10].labels == "apache-2,apache-2-notice,mit,mit-notice" and got[10].n_base == 2
    assert (got[10].first_word, got[10].last_word, got[10].n_words) == (1, 9, 14)
    assert (got[2].n_words, got[2].labels, got[2].score, got[2].first_word) == (0, "", 0.0, None)
    assert licenses.scan(empty(spark)).collect() == []


def test_templates():
    scan = licenses.scanner({"t": "one <<any:2>> two <<optional>> maybe so <</optional>> three"}, {})
    label = lambda text: scan(text)[5]
    assert all(label(t) == "t" for t in ("One two three", "x one a b TWO, maybe so three y", "one one two three", "one a two three"))
    assert not any(label(t) for t in ("one a b c two three", "one two maybe three", "one two", "two three", "One two threé"))


def test_phrases_of_the_whole_table(spark):
    import re

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op9_license_scan"](spark, SF).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((a for a, _ in at), default=None), max((a for a, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


# Equal rows


def test_equal_rows_spread(spark):
    from mealgrid.llm.common import numbered

    rows_ = spark.range(20000).select(F.lit(7).cast("bigint").alias("id"), F.lit("s").alias("source"), F.lit(3).cast("bigint").alias("size"))
    got = numbered(rows_.unionByName(rows_.limit(5).withColumn("id", F.col("id") + 1)))
    assert got.where("id = 7").select("_copy").distinct().count() == 20000 and got.count() == 20005
    mixed = mixing.mix(rows_, block=256).agg(F.sum(F.col("times") * F.col("size")).alias("t"), F.count("*").alias("n"), F.first("target").alias("g")).first()
    assert mixed.n == 20000 and abs(mixed.t - mixed.g) <= 3
    pieces = rows_.select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(700).cast("bigint").alias("length"), F.lit(5).cast("bigint").alias("ids_crc32"))
    pieces = spark.createDataFrame(pieces.toPandas(), packing.PIECES)
    packed = packing.packed(pieces, shard=1000)
    shards = packed.groupBy((F.col("sequence_id") / (1 << 32)).cast("int").alias("s")).count().collect()
    assert len(shards) == 20 and max(r["count"] for r in shards) < 1300
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_hidden_parts_end_with_their_own_tags(spark):
    cases = {
        "<head><style>p {}</style><title>TITLE</title></head><p>one</p>": "one",
        "<head><title>T</title><script>var h = '</head>'; x < 1</script></head><p>two</p>": "two",
        "<script>var s='</style>'; alert(1)</script><p>three</p>": "three",
        "<style>a{}</STYLE ><p>four</p><script>never ends <p>x</p>": "four",
        "<p>five</p><!-- a > b <p>no</p>": "five",
        "<title>lost</title><p>six<!-- <script> --></p>": "six",
        "<p>seven</p><header>kept</header>": "seven\nkept",
    }
    page_rows = pages(spark, [(i, "u", h) for i, h in enumerate(cases)])
    got = {r.page_id: r.block for r in warc.derivatives(warc.as_responses(page_rows)).where("record_type = 'conversion'").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_columns_with_names_made_here_stay(spark):
    rows_ = warc.as_responses(pages(spark, [(1, "u", "<p>x</p>")]))
    for name in ("_id", "_r", "_digest", "_uri", "_date", "_", "header", "block", "source_header"):
        rows_ = rows_.withColumn(name, F.lit(name))
    got = warc.derivatives(rows_)
    assert {"_id", "_r", "_digest", "_uri", "_date", "_", "source_header", "source_header_", "source_block", "header", "block"} <= set(got.columns)
    assert len(set(got.columns)) == len(got.columns)
    r = got.where("record_type = 'conversion'").first()
    assert (r["_r"], r["source_block"], r["source_header_"], r["source_header"], r["block"]) == ("_r", "block", "header", "source_header", "x")


def test_many_phrases_in_one_text():
    scan = licenses.scanner()
    text = "so under the MIT license it is " * 20000
    n_words, n_base, first, last, *_ = scan(text)
    assert (n_words, n_base, first, last) == (140000, 20000, 1, 139994)


def test_deep_pages_are_read_in_linear_time():
    """Work that grows with the square of the open elements would take hours here."""
    n = 150_000
    assert html.parsed("<div>x" * n)[0] == ["x"] * n
    assert html.parsed("<div><li>y</li>" * n)[0] == ["y"] * n
    assert html.parsed("<article>" + "a <span class='notice'>x</span>" * n)[0] == [" ".join("a" * n)]
    assert html.parsed("<form>" * n + "<article>z</article>")[0] == ["z"]


def test_all_unicode_white_space_is_one_space():
    assert html.parsed("<p>&emsp;a&thinsp;　b  c&nbsp; d\x85</p>")[0] == ["a b c d"]
