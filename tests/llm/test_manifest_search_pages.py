"""The Merkle manifest, ranked search and page extraction, against plain versions and on odd rows."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest

from tests.oracle import differences
from tidemark.llm import merkle, pages, queries, search

SF = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The top of a list of nodes, and the siblings of each from below, left and right ones apart."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(proofs):
            first = at[k] - at[k] % 3
            p.append(("".join(nodes[first : at[k]]), "".join(nodes[at[k] + 1 : first + 3])))
            at[k] //= 3
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> leaf, subroot, root, proof digest, folded root of the tampered row."""
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h("".join(map(field, r))), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([leaf for *_, leaf, _ in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, above = tree([subs[s][0] for s in order])
    for s, up in zip(order, above):
        for (_, _, leaf, r), own in zip(sorted(groups[s], key=lambda x: x[:3]), subs[s][1]):
            proof, node = own + up, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = h("".join(map(field, (*r[:4], r[4].replace("\n", "")))))
            for left, right in proof:
                node = h(left + node + right)
            out.append((r[0], leaf, subs[s][0], root, h("".join(a + b for a, b in proof)), node, node == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op11_merkle(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.mark.parametrize("height, top", [(8, 20_000), (1, 3), (2, 0)])
def test_manifest_is_the_plain_one(spark, tmp_path, monkeypatch, height, top):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "TOP", top)
    rows = [(i if i % 17 else None, [None, "", "b", "é", "big", "big", "big"][i % 7], None if i % 5 == 0 else "en", i, None if i % 11 == 0 else f"a\n{i}\nb") for i in range(100)]
    rows += [(7, "b", "en", 1, "x"), (7, "b", "en", 1, "x"), (7, "b", "en", 2, "y\n"), (8, "alone", None, None, "")]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(manifest(spark, rows, tmp_path), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_none_and_one(spark, tmp_path):
    assert manifest(spark, [], tmp_path / "a") == []
    leaf = h("1:5-2:en1:03:a\nb")
    ((_, got, sub, root, proof, folded, ok),) = manifest(spark, [(5, None, "en", 0, "a\nb")], tmp_path / "b")
    assert got == sub == root == leaf and proof == h("") and (folded == root) == ok


def test_manifest_of_many_groups_takes_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "TOP", 4)
    rows = [(i, f"s{i:03}", "en", i, "t") for i in range(60)]
    out = merkle.merkle_manifest(spark.createDataFrame(rows, DOCS).withColumnRenamed("doc_id", "path"), ["path", "source", "lang", "n_chars", "text"], id_col="path").collect()
    assert {(r.path, r.leaf, r.root) for r in out} == {(p[0], p[1], p[3]) for p in plain_manifest(rows)} and all(r.verified for r in out)


def test_treaps_give_the_best_of_any_postings():
    rng = np.random.default_rng(5)
    for _ in range(150):
        docs, terms, k = int(rng.integers(1, 60)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
        held = sorted({(int(rng.integers(terms)), int(rng.integers(docs))) for _ in range(int(rng.integers(1, 150)))})
        impact, weight = rng.integers(1, 8, len(held)), rng.integers(0, 4, terms)
        treaps = search.Treaps(np.array([t for t, _ in held]), np.array([d for _, d in held]), impact)
        score: dict = {}
        for (t, d), x in zip(held, impact.tolist()):
            score[d] = score.get(d, 0) + int(weight[t]) * x
        got = treaps.best(np.arange(terms), weight, k, 1)
        assert list(zip((-got[1]).tolist(), got[0].tolist())) == sorted((-s, d) for d, s in score.items() if s)[:k]


def test_treaps_of_equal_impacts_stay_shallow_and_prune():
    n = 20_000
    treaps = search.Treaps(np.zeros(n, np.int64), np.arange(n), np.full(n, 5))
    depth, level = 0, [treaps.root[0]]
    while level:
        depth, level = depth + 1, [c for i in level for c in (int(treaps.left[i]), int(treaps.right[i])) if c]
    assert depth < 60
    docs, _ = treaps.best(np.array([0]), np.array([3]), 10, 1)
    assert docs.tolist() == list(range(10))  # equal scores by id


@pytest.mark.parametrize("postings", [4_000_000, 10])
def test_search_on_odd_rows_is_its_sql(spark, tmp_path, monkeypatch, postings):
    monkeypatch.setattr(search, "POSTINGS", postings)
    docs = [(i, ["Alpha beta", "beta-GAMMA alpha alpha", "", None, "ÄÖ \x00 ß9 Beta", "delta " * 40][i % 6]) for i in range(60)] + [(3, "beta"), (3, "beta")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "beta, ALPHA beta"), (2, ""), (3, None), (4, "nowhere"), (5, "ÄÖ ß9 delta beta"), (5, "gamma")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert differences(spark, queries.op12_search, queries.ORACLE_SQL["op12_search"], str(tmp_path)) == []


def test_search_in_rounds_with_string_and_null_ids_and_clashing_names(spark, monkeypatch):
    docs = spark.createDataFrame([("b", "x y", 1), (None, "x y", 2), ("a", "x y", 3), ("c", "z", 4)], "doc_id string, text string, score int")
    items = spark.createDataFrame([("q", "x"), ("r", "y z"), ("s", "x")], "item_id string, text string")
    whole = search.ranked_search(docs, items, k=3).collect()
    assert [(r.rank, r.doc_id) for r in whole if r.item_id == "q"] == [(1, "a"), (2, "b"), (3, None)]
    monkeypatch.setattr(search, "ROUND_BYTES", 2)
    assert sorted(map(str, search.ranked_search(docs, items, k=3).collect())) == sorted(map(str, whole))
    assert search.ranked_search(docs.where("false"), items).count() == 0 == search.ranked_search(docs, items.where("false")).count()


LONG = "The quick fox jumps over the dog, and then it sleeps for a long while near the river bank. It was good."


@pytest.fixture(scope="module")
def model(spark):
    return pages.fit_pages(spark.read.parquet(f"{SF}/pages.parquet"))


def test_pages_of_the_table_against_patterns(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op13_pages(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<(?:b|br)>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        said = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (said, len(said))


@pytest.mark.parametrize("page, said", [
    (f"<body><div id=menu><a href=/>Home</a></div><div class='main-content'><h1>T</h1><p>{LONG}</p><div class=advert>{LONG}</div><p><a href=x>Only</a></p><ul><li>One<li>Two</ul></div><div class=sidebar><p>{LONG}</p></div><div class=comments><p>{LONG}</p><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div></body>", f"T\n{LONG}\nOnly\nOne\nTwo"),
    (f"<main><article><header>By X</header><h1>T</h1><p>{LONG}</p><aside>{LONG}</aside><form><label>Mail</label><button>Go</button></form><footer>f</footer></article><section id=comments><article class=comment><p>{LONG}</p></article></section></main>", f"T\n{LONG}"),
    (f"<body><div><a href=/>Home</a> | <a href=/b>B</a></div><div><div><h1>T</h1><p>{LONG}</p><p>x.</p><p>{LONG}</p></div></div></body>", f"T\n{LONG}\nx.\n{LONG}"),
    ("<article><p>a &lt;b&gt; &amp; &eacute;&#233;&#xe9; &notit; x<script>if(a</p>)</SCRIPT >y<!-- c > d --> z</p><P TITLE='1>2'>q<br>r &amp</P></article>", "a <b> & ééé ¬it; xy z\nq r &"),
    ("<article><p>one<p>two <span class=ad>buy</span> five<b>x</article>", "one\ntwo fivex"), ("", ""), ("<p>", ""), ("<!-- x", ""), ("<script>x", ""), ("a < b", "a < b"),
])
def test_layouts_that_the_table_lacks(model, page, said):
    assert pages.main_text(page, model)[0] == said


def test_deep_and_long_pages_and_odd_rows(spark, model):
    deep = "<article>" + "<div>" * 200 + f"<p>{LONG}</p>"
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article><footer>f</footer>"
    rows = [(1, "u", deep), (2, None, long), (3, "u", None), (3, "u", ""), (None, "u", "<article><p>x y.</p></article>")]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars"), model).collect()
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in got] == [LONG, "\n".join([LONG] * 20_000), "", "", "x y."] and [r.n_chars for r in got] == [len(r.text) for r in got]


def test_any_depth_is_read(model):
    assert pages.main_text("<article><p>x y.</p>" + "<div><b>" * 50_000 + LONG, model)[0].startswith("x y.")


def test_a_model_without_labelled_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract_pages(none, pages.fit_pages(none)).count() == 0
    assert pages.main_text(f"<nav><a href=1>Home</a></nav><p>{LONG}</p>", pages.fit_pages(none))[0] == LONG


def test_marginals_are_those_of_all_labellings(model):
    """Messages against the sum over every labelling of a small page."""
    import itertools

    t = pages.Tree(f"<div class=nav><a href=x>Home</a></div><div><p>{LONG}</p></div>")
    edges, weight = [model.edge(k) for k in t.kind], [0.0] * len(t.kind)
    for states in itertools.product(range(4), repeat=len(t.kind)):
        w = float(states[0] == pages.FRAME)
        for i in range(1, len(states)):
            w *= edges[i][states[t.parent[i]]][states[i]] * (model.texts[t.cell[i]][states[i]] if t.cell[i] else 1)
        for i, s in enumerate(states):
            weight[i] += w * (s == pages.CONTENT)
    total = sum(
        float(states[0] == pages.FRAME) * np.prod([edges[i][states[t.parent[i]]][states[i]] * (model.texts[t.cell[i]][states[i]] if t.cell[i] else 1) for i in range(1, len(states))])
        for states in itertools.product(range(4), repeat=len(t.kind))
    )
    assert np.allclose([w / total for w in weight], model.marginals(t))
