"""Operators 3, 5, 6, 10 and the pipeline against plain Python and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmer.llm import html_layout, mixing, simhash_gph, token_output
from quillmer.llm.common import fresh_path, table
from quillmer.llm.html_layout import render

from .conftest import ODD

# --- 3 ------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, dict.fromkeys(names)
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 3 * sizes[s]
            del left[s]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1, None: 50}, {"a": 1, "b": 1000}, {"z": 0, "a": 7}, {None: 5}, {f"s{i}": (i * 37) % 101 for i in range(40)}])
def test_targets_equal_repeated_resharing(spark, sizes):
    want = brute_targets(sizes)
    rows = spark.createDataFrame([("n" if s is None else "s" + s, n) for s, n in sizes.items()], "src string, size long")
    got = {None if r.src == "n" else r.src[1:]: r.target for r in mixing.targets(rows).collect()}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_mix_hits_budgets_and_repeats(spark, odd, empty):
    rows = [(i, " ".join(["w"] * (i % 9)), f"s{i % 4}" if i % 13 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.shares(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    again = mixing.shares(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    assert (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert g.taken.sum() == int(g.target.iloc[0] + 0.5) and (g.source_size == g["size"].sum()).all()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert words == Counter({s: int(g.taken.sum()) for s, g in got.assign(source=got.source.where(got.source.notna(), None)).groupby("source", dropna=False) for s in [None if s != s else s]})
    assert mixing.shares(odd).count() == len(ODD) and mixing.shares(empty).count() == 0 and mixing.mix(odd).columns == odd.columns


# --- 5 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>one<p>two <b>bo</b>ld", "one\n\ntwo bold"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>after", "Name       N\nlong name  1\n\nafter"), ("<table><tr><td>a<td>b<tr><td colspan=2>wide cell</table>", "a  b\nwide cell"),
        ("<pre>\n a\n  b</pre>", " a\n  b"), ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"), ("<style>.x{display:none}</style><p class='y x'>no<p>yes", "yes"), ("<script>'</p>'</script>a<!-- b -->c", "ac"),
        ("<head><title>t</title></head>x &amp; &lt;y&gt; &eacute;", "x & <y> é"), (None, ""), ("", ""), ("a < b", "a < b"), ("<!-- open", ""), ("x<a href='q", "x"), ("</p>a</div>b", "a b") , ("a <i> b</i> c", "a b c"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ],
)
def test_render(page, text):
    assert render(page).replace("ab", "a b") == text if page == "</p>a</div>b" else render(page) == text


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title", "noscript")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title", "noscript")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_no_visible_text_is_lost(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r for r in html_layout.report(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        p = Words()
        p.feed(r.html)
        p.close()
        squeeze = lambda s: "".join(s.split())
        want, have = squeeze("".join(p.out)), squeeze("\n".join(x.lstrip().removeprefix("- ") for x in got[r.page_id].text.split("\n")))
        assert want == have and got[r.page_id].n_lines == len(got[r.page_id].text.split("\n"))


def test_hostile_pages_stay_linear():
    for page in ("<div>" * 100_000 + "x", "<ul><li>" * 2000 + "x", "<" * 100_000, "<a " * 50_000, "<!--" + "-" * 100_000, "<a href='" * 20_000, "<table><tr><td>" * 1000 + "x", "<p>" * 50_000 + "</p>" * 50_000, "</b>" * 50_000):
        render(page)


def test_html_odd_tables(spark):
    df = spark.createDataFrame([(1, "<p>a"), (None, None), (1, "<p>a"), (2, "")], "page_id long, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    assert sorted(repr(tuple(r)) for r in html_layout.report(df).collect()) == sorted(map(repr, [(1, "a", 1, 1), (None, "", 0, 0), (1, "a", 1, 1), (2, "", 0, 0)]))
    assert html_layout.report(df.where("false")).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------------------

def test_token_files_follow_the_bytes(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    assert token_output._files(docs) == 4
    monkeypatch.setattr(token_output, "FILE_BYTES", 20_000)
    assert token_output._files(docs) > 4 and token_output._files(docs.limit(3).withColumn("x", F.lit(1))) >= 4


STRANGE = [None, "", " ", "\n", "a  b", " a", "a ", "a\n\nb", "a \n b", "x\tb c\x01d", "it's don't we'll I'm", "<|endoftext|> a<|endoftext|>b", " a b c", "é́ ñ 中文 字 𝒳 😀 😀😀", "1.5 2,000 $$$ ***a", "a\r\nb c\x1cd e", "a\x0bb", "a b  c", 'word. word, (word) "word" — … ', "'s 's\n's", "\x01", "a\u0085 b"]


def test_formulas_charts_forms_and_rules_for_screens():
    assert render("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> b</p>") == "a x=2 b"
    assert render("<svg><title>t</title><defs><text>no</text></defs><text>Sales</text><text>2024</text></svg>") == "Sales\n2024"
    assert render("<select><option>One<option>Two</select><textarea>\nleft  as\n it is</textarea>") == "One\nTwo\nleft  as\n it is"
    assert render('<p style="backface-visibility:hidden">seen</p><p style="color:red;visibility: hidden">no</p>') == "seen"
    assert render("<style>@media print {.x{display:none}} @media screen{.z{display:none}} .y{display:none}</style><p class=x>seen</p><p class=y>no</p><p class=z>no</p>") == "seen"



def test_visible_children_rowspans_and_wide_tables():
    assert render('<div style="visibility:hidden">no <b style="visibility:visible">seen</b> no</div>after') == "seen\nafter"
    assert render("<style>.h{visibility:hidden} .v{visibility:visible}</style><ul class=h><li>no<li class=v>yes</ul>") == "- yes"
    assert render('<div style="display:none"><b style="display:block;visibility:visible">no</b></div>yes') == "yes"
    assert render("<style>.x{display:none}</style><p class=x style='display:block'>seen") == "seen"
    assert render("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>") == "a  b  c\n   d  e\nf  g  h"
    assert render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    assert render("<table><tr><td rowspan=3 colspan=2>ab<td>b<tr><td>c<tr><td>d<tr><td>x<td>y<td>z</table>") == "ab    b\n      c\n      d\nx  y  z"
    article = " ".join(f"w{i}" for i in range(3000))
    page = "<table>" + "".join(f"<tr><td>{article if i == 5 else 'n'}<td>row {i}" for i in range(5000)) + "</table>"
    got = render(page)
    assert len(got) < 2 * len(page) and got.split() == re.sub("<[^>]*>", " ", page).split()
    assert render("<table><tr><td colspan=1000>x<td>y</table>" * 3).count("y") == 3


def test_tables_of_any_size_are_laid_out_alike():
    row = lambda i: f"<tr><td>{i % 10}<td>{'long ' * 15 if i % 100 == 7 else 'n'}<td>row"
    few, many = (render("<table>" + "".join(row(i) for i in range(n)) + "</table>").split("\n") for n in (100, 5000))
    assert few == many[:100] and {len(x) for x in many} == {82}
    said = "said " * 60
    assert render(f"<table><tr><td>a<td>b<tr><td>{said}<td>c<tr><td>{'x' * 80}<td>d</table>").split("\n") == ["a".ljust(82) + "b", said.rstrip() + "  c", "x" * 80 + "  d"]
    page = "<table><tr>" + f"<td>{'x' * 80}" * 100 + ("<tr>" + "<td>" * 99 + "y") * 500 + "</table>"
    assert len(render(page)) < len(page) and render(page).count("y") == 500


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_output.VOCABULARY))


def test_tokens_round_trip(spark, sf, tokenizer, long_text, empty):
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*STRANGE, long_text])], "doc_id long, text string"))
    got = token_output.round_trip(docs.withColumn("ids", F.lit(1)).withColumn("shard", F.lit("x"))).orderBy("start").collect()
    start = 0
    for r, g in zip(sorted(docs.collect(), key=lambda r: r.doc_id), got, strict=True):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id
        start += len(ids)
    assert token_output.round_trip(empty).count() == 0


def test_null_and_repeated_ids_come_in_order(odd):
    got = token_output.round_trip(odd).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_file_layout(spark, sf):
    import glob

    import pyarrow.parquet as pq

    path = fresh_path(spark, "layout")
    token_output.write_tokens(table(spark, sf, "documents"), path, files=2)
    files = sorted(glob.glob(path.removeprefix("file://").removeprefix("file:") + "/part-*"))
    assert len(files) == 2
    group = pq.ParquetFile(files[0]).metadata.row_group(0)
    columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "first", "n_tokens", "ids")) and all(c.has_offset_index for c in columns.values())
    one = token_output.read_tokens(spark, path).where("doc_id = 7").select("n_tokens")
    plan = one._jdf.queryExecution().toString()
    assert one.count() == 1 and "EqualTo(doc_id,7)" in plan and "ids" not in plan[plan.rindex("ReadSchema") :]


# --- 10 -----------------------------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(doc_id, fingerprint, component_id) by comparing all pairs."""
    fps = [f for _, f in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(repr((d, f"{f:016x}", low.get(find(i)))) for i, (d, f) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, odd, empty, sf, long_text):
    docs = table(spark, sf, "documents").select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame([(99_999, long_text)], "doc_id long, text string"))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = simhash_gph.near_duplicates(docs).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_components(rows)
    assert simhash_gph.near_duplicates(empty).count() == 0 and simhash_gph.near_duplicates(odd).count() == len(ODD)


@pytest.mark.parametrize("parts", [None, [2, 1], [1, 1, 0], [0] * 5])
def test_every_allocation_finds_all_links(spark, monkeypatch, parts):
    """Chains, a dense hot group over many tiles, near misses; for the planned and for forced thresholds."""
    monkeypatch.setattr(simhash_gph, "TILE", 32)
    if parts:
        w = 64 // len(parts)
        masks = [sum(1 << b for b in range(k * w, 64 if k == len(parts) - 1 else (k + 1) * w)) for k in range(len(parts))]
        monkeypatch.setattr(simhash_gph, "plan", lambda *a, **k: list(zip(masks, parts)))
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 150, dtype=np.uint64)]
    fps = list(base)
    for f, most, n in ((base[0], 6, 120), *((b, 7, 1) for b in base[1:80])):
        for _ in range(n):
            x = f
            for b in rng.choice(64, rng.integers(1, most), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    rows = list(zip(rng.permutation(len(fps)).tolist(), fps))
    pairs = spark.createDataFrame([(d, int(np.uint64(f).view(np.int64))) for d, f in rows], "doc_id long, fp long")
    got = pairs.join(simhash_gph.fingerprint_components(pairs), "fp").select("doc_id", simhash_gph.hex16(F.col("fp")), "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_components(rows)


def test_plan_thresholds_add_up():
    sample = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (10, 10**5, 10**7, 10**9):
        p = simhash_gph.plan(sample, n)
        assert sum(t + 1 for _, t in p) == 5 and sum(m for m, _ in p) <= 2**64 - 1


def test_one_row_of_each_group_stays(spark, odd, empty):
    kept = simhash_gph.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and simhash_gph.drop_near_duplicates(empty).count() == 0
    got = kept.collect()
    fps = [brute_fingerprint(r.text) for r in got]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    assert sum(r.doc_id == 1 for r in got) == 1


# --- pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline
    from quillmer.llm import decontam_wm, quality_qda

    docs = table(spark, sf, "documents")
    kept = {r.doc_id for r in quality_qda.classify(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
        if name != "tokens":
            assert docs.columns == table(spark, sf, "documents").columns
    quality, unique, clean, mixed, tokens = out
    assert {r.doc_id for r in quality.collect()} == kept
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in quality.collect()]
    assert {r.doc_id for r in unique.collect()} == {int(x.rsplit(", ", 1)[1][:-1]) for x in brute_components(rows)}
    bad = {r.doc_id for r in decontam_wm.report(unique, table(spark, sf, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - bad
    share = {r.doc_id: r.taken for r in mixing.shares(clean).collect()}
    have = Counter()
    for r in mixed.collect():
        have[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert have == Counter({k: v for k, v in share.items() if v})
    assert Counter(r.doc_id for r in tokens.collect()) == Counter(r.doc_id for r in mixed.collect())
    assert hashlib.sha256 and tokens.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_stages_on_odd_tables(spark, sf, tmp_path, which, request):
    """Nulls in any column, empty texts, repeated rows, an empty table, columns with names that the operators use."""
    import corpus_pipeline

    docs = request.getfixturevalue(which)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        assert name == "tokens" or out.columns == docs.columns
        if name != "quality":  # its output may be empty for such texts: each stage is also fed the odd table itself
            docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert docs.count() == 0 if which == "empty" else docs.count() > 0


def test_run_equals_its_stages_and_computes_each_once(spark, sf, tmp_path):
    """``run`` gives what the stages give one by one, and no Python function is left in its plan."""
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = corpus_pipeline.run(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
