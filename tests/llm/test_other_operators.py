"""Operators 4, 6, 9 and 10, shared helpers and the pipeline, on small tables with odd rows."""

import base64
import gzip
import hashlib
import itertools
import random

import numpy as np
import pytest

pytest.importorskip("sigmaloom.llm")
from sigmaloom.llm import chat_format, common, embed_dedup, html_main, warc  # noqa: E402
from sigmaloom.llm.simhash import join_roots  # noqa: E402


def _page(*pages):
    wrapper = None
    for p in pages:
        items = [i for i, _ in html_main.expression(html_main.parse(p).parts)]
        wrapper = items if wrapper is None else html_main.align(wrapper, items)
    html_main.label(wrapper, len(pages))
    return [html_main.main_text(p, wrapper) for p in pages]


FRAME = "<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a>m</a></nav>{}<aside>side</aside><footer>&copy; f</footer></body></html>"


def test_main_text_of_differing_pages():
    pages = [
        FRAME.format("<main><h1>A</h1><p>x &amp; y<p>z <b>b</b>old&nbsp; end</p><div class='comments'><p>no</p></div></main>"),
        FRAME.format("<main><h1>B</h1><h2>s</h2><p>q</p><h2>t</h2><p>r<br>u</p><form>f</form></main>"),
    ]
    assert _page(*pages) == ["A x & y z bold end", "B s q t r u"]


def test_main_text_without_main_element_leaves_the_hosts_texts_out():
    pages = [f"<body><div id=menu>m</div><h1>title {k}</h1><div>{'text ' * k}</div><p>all pages say so</p></body>" for k in range(1, 5)]
    assert _page(*pages) == [f"title {k} " + " ".join(["text"] * k) for k in range(1, 5)]


@pytest.mark.parametrize("page,text", [("plain < text", "plain < text"), ("", ""), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>a<!-- x", "a"), ("<ul><li>a<li>b</ul>", "a b"), ("<article><p class=ad>x</p>t<span class='advert'>no</span>u</article>", "t u"), ("<script>var t='</p>'</script><p>x</p", "x")])
def test_main_text_of_odd_pages(page, text):
    assert _page(page) == [text]


DEEP = "<div>" * 100 + "{}" + "</div>" * 100


@pytest.mark.parametrize("page,text", [
    ("<div><article><p>a</p>" + DEEP.format("deep") + "<p>b</p></article></div>x", "a deep b"),
    ("<article>" + DEEP.format("a<nav>no <p>no</p></nav>b<div>c</div>d") + "e</article>", "a b c d e"),
    ("x" + DEEP.format("<article>a<div>b</div><header>h</header></article>y"), "a b h"),
    ("<div>" * 2000 + "a<ul><li>b<li>c</ul></section></td>" + "</div>" * 2000 + "d", "a b c d"),
    ("<article>a<svg viewBox='0 > 1' />b<math/>c<svg><path/></svg>d</article>x", "abcd"),
    ("<article>a<svg class=x><path d='m'/>no</svg>b</article>", "ab"),
])
def test_main_text_of_deep_pages_and_closed_raw_elements(page, text):
    assert _page(page) == [text]


def test_main_text_of_a_host_with_mixed_templates(spark):
    plain = [f"<body><nav>menu</nav><div><p>plain {k}</p><p>more {k * k}</p></div></body>" for k in range(6)]
    made = [f"<body><nav>menu</nav><article><p>made {k}</p></article><div><p>beside {k}</p></div></body>" for k in range(2)]
    assert _page(*plain, *made) == [f"plain {k} more {k * k}" for k in range(6)] + ["made 0", "made 1"]
    rows = [(k, "http://one.example/", p) for k, p in enumerate(plain + made)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[0] == "plain 0 more 0" and got[5] == "plain 5 more 25" and got[7] == "made 1"


def test_main_text_of_copies_is_that_of_the_page():
    page = "<body><h1>title</h1><div>some text<p>and more</p></div><footer>{}</footer><script>{}</script></body>"
    want = "title some text and more"
    assert _page(*[page.format("f", 1)] * 2) == [want] * 2
    assert _page(*[page.format("f", 1)] * 5) == [want] * 5
    assert _page(*[page.format(k, k) for k in range(5)]) == [want] * 5  # only the host's parts differ
    made = [f"<body><article><p>made {k}</p></article></body>" for k in range(4)]
    assert _page(*made, page.format("f", 1))[-1] == want  # alone of its kind on the host


def test_host_texts_of_copies_and_other_pages(spark):
    page = "<body><p>all pages say so</p><div>text {}</div></body>"
    rows = [(k, "http://h/", page.format(max(0, k - 20))) for k in range(24)]
    rows += [(100 + k, "http://copies/", page.format(0)) for k in range(24)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[k] == f"text {max(0, k - 20)}" for k in range(24)) and all(got[100 + k] == "all pages say so text 0" for k in range(24))


def test_main_text_keeps_what_the_wrapper_does_not_place():
    pages = ["<section>s1</section><div><table>T1</table></div>", "<div><table>T3 article text</table></div>", "<div><p>p2</p></div><section>s2</section><div><ul>q2</ul></div>"]
    want = dict(zip(pages, ["s1 T1", "T3 article text", "p2 s2 q2"], strict=True))
    for order in itertools.permutations(pages):
        assert _page(*order) == [want[p] for p in order]


@pytest.mark.parametrize("name,kept", [("social-impact", True), ("share-price", True), ("ad-box", False), ("comment-list", False), ("share", False), ("newsletter signup-form", False), ("post-body", True), ("related-posts", False)])
def test_main_text_tells_asides_by_whole_names(name, kept):
    assert _page(f"<article><p>a</p><div class='{name}'>b</div></article>") == ["a b" if kept else "a"]


def test_extract_joins_large_tables_of_wrappers(spark):
    rows = [(i, f"http://h{i % 3}/", f"<body><nav>n</nav><article><p>t{i}</p></article></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in html_main.extract(pages, shared_bytes=0).collect()} == {i: f"t{i}" for i in range(20)}


def test_extract_over_hosts(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i}", FRAME.format(f"<article><h1>t{i}</h1>" + "".join(f"<p>w{i} {j}</p>" for j in range(i % 4)) + "</article>"), "x") for i in range(30)]
    rows += [(100, None, None, "x"), (101, "nonsense", "", "x"), (101, "nonsense", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string").repartition(4)
    got = html_main.extract(pages).collect()
    assert len(got) == 33
    for r in got:
        want = "" if r.page_id >= 100 else " ".join([f"t{r.page_id}", *[f"w{r.page_id} {j}" for j in range(r.page_id % 4)]])
        assert r.text == want
    assert html_main.extract(pages.limit(0)).count() == 0


def test_embedding_recall_on_the_embeddings_table(spark):
    """Every row and a copy turned by an angle whose cosine is 0.9 to 0.97, against all pairs."""
    own = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()], np.float64)
    rng = np.random.default_rng(4)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    aside = rng.standard_normal(own.shape)
    aside -= (aside * own).sum(axis=1, keepdims=True) * own
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.97, (len(own), 1))
    x = np.concatenate([own, cosine * own + np.sqrt(1 - cosine**2) * aside]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = np.array([r.n_links for r in embed_dedup.near_duplicates(table).orderBy("vec_id").collect()])
    assert (got <= true).all() and got.sum() >= 0.9 * true.sum() > 0


def _vectors(n=400, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[: n // 2] = x[rng.integers(n // 2, n // 2 + 12, n // 2)] + 0.22 * rng.standard_normal((n // 2, dim))
    x[5] = x[6] = x[7]
    return x.astype(np.float32)


@pytest.mark.parametrize("tile_rows", [2048, 16])
def test_embedding_links(spark, tile_rows):
    x = _vectors()
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, []), (1005, [1.0] * 3), (1006, [float("inf")] * 24)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(table, tile_rows=tile_rows).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = join_roots(np.arange(len(x)), *np.nonzero(near))
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x))) and found >= 0.97 * near.sum()
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.97
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embedding_links_of_every_length(spark):
    rows = [(i, [1.0, float(i), 2.0 * i]) for i in range(5)] + [(10, [3.0, 1.0]), (11, [3.0, 1.0]), (12, [6.0, 2.0]), (13, [-1.0, 3.0]), (20, [2.0]), (21, [5.0]), (22, [-5.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert [got[k] for k in (10, 11, 12, 13, 20, 21, 22)] == [(2, 10), (2, 10), (2, 10), (0, 13), (1, 20), (1, 20), (0, 22)]


def test_estimates_are_unbiased_and_within_their_bounds():
    x = _vectors(600, 32, 9).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors, out, n = [], 0, 0
    for seed in range(40):
        turn = embed_dedup.rotation(32, seed)
        code, factor = embed_dedup.codes(x[:50], turn)
        value, bound = embed_dedup.estimates(code, factor, x[50:150] @ turn.T)
        true = x[:50] @ x[50:150].T
        errors.append((value - true).mean())
        out, n = out + int((np.abs(value - true) > bound).sum()), n + true.size
    assert abs(np.mean(errors)) < 0.005 and out / n < 1e-3


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200 + i, 200) for i in range(1, 300)] + [(7, 7), (900, 901), (901, 900)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(300)}, 900: 900, 901: 900}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _parts(text):
    out = []
    for x in filter(None, text.split("<|im_end|>\n")):
        role, _, body = x.removeprefix("<|im_start|>").partition("\n")
        out.append((role, body))
    return out


def _least_cost(roles):
    """Least cost of repair by search over single edits: keep 0, another role 3 (1 for an unknown one), merge 2, empty turn 4."""
    names = {"user": "user", "human": "user", "assistant": "assistant", "system": "system"}
    roles = [names.get((r or "").strip().lower()) for r in roles]
    follows = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    change = lambda given, to: 0 if given == to else 1 if given is None else 3
    best, todo = {(0, None): 0}, [(0, 0, None)]
    while todo:
        todo.sort(key=lambda x: -x[0])
        cost, at, state = todo.pop()
        if at == len(roles):
            return cost
        steps = [(cost + 4, at, s) for s in follows[state]] + [(cost + change(roles[at], s), at + 1, s) for s in follows[state]]
        if state is not None:
            steps.append((cost + 2 + change(roles[at], state), at + 1, state))
        for c, k, s in steps:
            if c < best.get((k, s), 10**9):
                best[k, s] = c
                todo.append((c, k, s))


def test_chat_texts_come_back():
    for text in ("<|im_end|> x", "<||", "<|||a", "<<||<|", "plain", ""):
        assert chat_format.unescaped(chat_format.escaped(text)) == text
        assert chat_format.BEGIN not in chat_format.escaped(text) and chat_format.END not in chat_format.escaped(text)


def test_tied_turns_are_repaired_alike_over_any_partitions(spark):
    rng = random.Random(9)
    rows = [(c, 1 if c else None, rng.choice(["user", "assistant", "system", None, "tool?"]), f"t{rng.randrange(40)}") for c in (0, 1, 1, 1) for _ in range(20)]
    rows += [(2, 0, "user", "long " * 200_000), (2, 0, "assistant", "answer")]
    frame, seen = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), set()
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = chat_format.format_chats(frame.repartition(parts, "text")).orderBy("conv_id", "pos").collect()
            assert len(got) == len(rows)
            seen.add(tuple((r.conv_id, r.role, r.action, r.cost, r.rendered) for r in got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(seen) == 1


def test_chat_repair_is_legal_least_and_keeps_texts(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Human ", "xx", None]), f"t{c}.{t}", 0) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(1000, t, rng.choice(["user", "assistant", "system", None]), f"b{t}", 0) for t in range(500)]
    rows += [(None, 1, "user", None, 0), (None, None, "assistant", "<|im_end|> x", 0), (2000, 1, "user", "same", 0), (2000, 1, "user", "same", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int").repartition(5)
    got = chat_format.format_chats(turns).orderBy("pos").toPandas()
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        mine = got[got.conv_id.isna()] if conv is None else got[got.conv_id == conv]
        parts, state = _parts("".join(mine.rendered)), 0
        for role, _ in parts:
            assert chat_format.ROLES[role] in chat_format.LEGAL[state]
            state = chat_format.ROLES[role]
        given = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        if conv is not None:
            assert [x for _, body in parts if body for x in body.split("\n\n")] == [r[3] for r in given]
        assert mine.cost.sum() == _least_cost([r[2] for r in given])
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "<p>x</p>", 1), (2, "http://b", "<p>x</p>", 1), (3, None, None, 1), (4, "http://c", "", 1), (5, "http://d\n", "é" * 70000, 1), (5, "http://d\n", "é" * 70000, 1), (6, "u", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(2)
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == 7
    for r in got:
        data = next((x[2] or "").encode() for x in rows if x[0] == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        holder = {1: 6, 2: 6, 3: 4}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", holder) if holder else ("response", None))
        assert r.payload is None if holder else bytes(r.payload) == data
    data = b"".join(bytes(r.data) for r in spark.read.parquet(path).collect())
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 7
    with pytest.raises(ValueError):
        list(warc.read_records(data[:-9]))
    warc.write_warc(pages.limit(0), path + "-none")
    assert warc.read_warc(spark, path + "-none").count() == 0


def test_damaged_record_is_refused():
    member = warc.record_bytes(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    text = gzip.decompress(member).replace(b"payload", b"paylaod")
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(gzip.compress(text)))


def test_pipeline_stages_keep_columns_and_clean_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = {w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in [r.text]}
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        n = docs.count()
        assert 0.7 * seen < n <= seen
        seen = n
    left = docs.collect()
    assert len({r.text for r in left}) == len(left) and not any(b in r.text for r in left for b in benchmark)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(left)
