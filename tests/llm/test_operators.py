"""The operators against brute force, exact round trips and held-out accuracy, on small whole tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopmark.llm import bpe, common, decontaminate, html_extract, importance, language_id, license_scan, media, pseudo_likelihood, queries, simhash, token_store
from hopmark.llm.common import TOKEN_BYTES, Words, hash_spans
from hopmark.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, id long, fp long, rep long, weight long, c0 string, _copy_id long, _contaminated_key long"
LONG = "Lorem IPSUM dolor " * 30_000
ODD = [None, "", "   \n\t ", "A", "mit license MIT-License", "it's  <|endoftext|> x", "日本語 テスト हिन्दी 😀", "x" * 5000, LONG, "###!!! 123 456", "MIT", "\x85\x1c a b"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df().replace({np.nan: None})


@pytest.fixture(scope="module")
def docs():
    return dict(zip(*(table("documents")[c].tolist() for c in ("doc_id", "text")), strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", 1, 2, 3, 4, "c", 5, 6) for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None, None, None, None, None, None), (3, "A", "en", 1, 2, 3, 4, "c", 5, 6), (7, "another text of id 7", None, 1, 2, 3, 4, "c", 5, 6)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def result(spark, name, sf=SF):
    return {r[0]: r.asDict() for r in queries.queries()[name](spark, sf).collect()}


# 1


def test_license_scan_finds_all_places(spark, docs):
    got = result(spark, "op1_license_scan")
    labelled = 0
    for i, t in docs.items():
        w = words(t)
        at = {j: label for p, label in license_scan.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()}
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({*at.values()}))
        assert {*at.values()} <= {*r["labels"].split(",")}
        assert 0 <= r["score"] <= 1
        assert ("cc-by-nc-4.0" in r["labels"]) == ("Licensed under CC BY-NC 4.0" in t)
        labelled += bool(at)
    assert labelled


def test_license_scan_odd_rows(odd, none):
    rows = license_scan.license_scan(odd).collect()
    assert len(rows) == odd.count() and license_scan.license_scan(none).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["places"] == [0, 2] and by[0]["n_words"] == 0 and by[0]["labels"] == "" and by[0]["first_word"] is None


def test_license_needs_key_phrase():
    index = license_scan.Index(license_scan.TEMPLATES, license_scan.PHRASES)
    full = license_scan.words_of(b"x x Permission is hereby granted, free of charge, to any person obtaining a copy of this software and")
    assert index.scan(full, 0.8)[2] == {"mit"}
    broken = license_scan.words_of(b"x x Permission is hereby not granted, free of charge, to any person obtaining a copy of this software")
    assert index.scan(broken, 0.8)[2] == set()
    wider = license_scan.words_of(b"x Permission is hereby granted, free of charge to every and any person now obtaining a copy of this software")
    assert index.scan(wider, 0.8)[2] == {"mit"}


def brute_labels(words, cover=0.8):
    """Every window of every template, by a table of common subsequences."""
    out = set()
    for t in license_scan.TEMPLATES:
        template, keys = license_scan.words_of(t.text.encode()), [license_scan.words_of(k.encode()) for k in t.keys]
        size = len(template) + 3 * license_scan.slack_of(template)
        for s in range(max(1, len(words) - size + 1)):
            text = words[s : s + size]
            row = [0] * (len(template) + 1)
            for w in text:
                new = [0]
                for i, v in enumerate(template):
                    new.append(row[i] + 1 if v == w else max(row[i + 1], new[i]))
                row = new
            if row[-1] >= license_scan.needed(template, cover) and all(any(text[i : i + len(k)] == k for i in range(len(text))) for k in keys):
                out.add(t.label)
                break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_license_labels_against_brute_force(seed):
    """Notices with words left out, inserted and changed, in prose of their own words."""
    rng = np.random.default_rng(seed)
    index = license_scan.Index(license_scan.TEMPLATES, license_scan.PHRASES, {w: float(rng.random()) for t in license_scan.TEMPLATES for w in license_scan.words_of(t.text.encode())})
    found = 0
    for k in rng.choice(len(license_scan.TEMPLATES), 8, replace=False):
        template = license_scan.words_of(license_scan.TEMPLATES[k].text.encode())
        change = rng.random(len(template)) < rng.choice([0.0, 0.05, 0.4])
        text = [b"other%d" % i for i in range(40)]
        for w, c in zip(template, change, strict=True):
            text += [[], [w, b"extra"], [b"changed"]][rng.integers(0, 3)] if c else [w]
        text += list(rng.choice(template, 6)) + [b"end"] * 30
        got = index.scan(text, 0.8)[2]
        assert got == brute_labels(text), (license_scan.TEMPLATES[k].label, change)
        found += bool(got)
    assert found


@pytest.mark.parametrize("n", [99, 300])
def test_license_scan_finds_notices_of_many_files(spark, n):
    ends = ("Licensed under CC BY-NC 4.0", "licensed under the Apache License, Version 2.0", "nothing")
    rows = spark.createDataFrame([(i, f"some text {ends[i % 3]}") for i in range(n)], "doc_id long, text string")
    got = {r["doc_id"]: {*r["labels"].split(",")} for r in license_scan.license_scan(rows).collect()}
    assert all("cc-by-nc-4.0" in got[i] and "apache-2.0" in got[i + 1] and got[i + 2] == {""} for i in range(0, n, 3))


def test_license_scan_finds_all_notices_of_a_file():
    frequent = dict.fromkeys([b"licensed", b"under", b"cc", b"by", b"nc", b"4", b"0"], 1.0)
    index = license_scan.Index(license_scan.TEMPLATES, license_scan.PHRASES, frequent)
    both = b"Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Licensed under CC BY-NC 4.0"
    assert index.scan(license_scan.words_of(both), 0.8)[2] == {"mit", "cc-by-nc-4.0"}
    every = license_scan.words_of(" and so on ".join(t.text for t in license_scan.TEMPLATES).encode())
    assert index.scan(every, 0.8)[2] == {t.label for t in license_scan.TEMPLATES}


# 2


def test_importance_against_brute_force(spark, docs):
    labels = {}
    for d, q in table("labels")[["doc_id", "quality"]].itertuples(index=False):
        labels[d] = min(q, labels.get(d, q))
    frame, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = importance.fit_models(frame, lab)
    assert dict(zip(model.ids.tolist(), (model.label > 0).tolist(), strict=True)) == {d: q > 0 for d, q in labels.items()}

    def grams(text):
        w = Words([text.encode()], TOKEN_BYTES, lower=False)
        one, two, _ = importance.ngrams([text.encode()])
        assert [w.word(i) for i in range(len(w.starts))] == re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode())
        return [*one, *two[two >= 0]]

    raw, target = Counter(), Counter()
    chosen = {d for d, x in zip(model.ids.tolist(), model.label.tolist(), strict=True) if x == 2}
    for i, t in docs.items():
        raw.update(g := grams(t))
        target.update(g if i in chosen else [])
    q = {b: (n + 1) / (sum(raw.values()) + importance.BUCKETS) for b, n in raw.items()}
    p = {b: (target[b] + importance.PRIOR * q[b]) / (sum(target.values()) + importance.PRIOR) for b in raw}
    rows = {r["doc_id"]: r for r in importance.importance_resample(frame, lab).collect()}
    for i, t in docs.items():
        want = sum(np.log(p[b] / q[b]) for b in grams(t))
        assert abs(rows[i]["log_weight"] - want) < 1e-2 and rows[i]["n_ngrams"] == len(grams(t))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    number = lambda v, seed: xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)
    keys = {}
    for i, t in docs.items():
        if n := rows[i]["n_ngrams"]:
            tie = signed(xxhash.xxh64_intdigest(t.encode(), number(i, 42)))
            uniform = (signed(number(importance.SEED, number(tie, 42))) % 2**52 + 0.5) / 2**52
            keys[i] = importance.NGRAMS * sum(np.log(p[b] / q[b]) for b in grams(t)) / n - np.log(-np.log(uniform))
            assert abs(rows[i]["gumbel_key"] - keys[i]) < 0.01
    chosen = [r["doc_id"] for r in importance.importance_resample(frame, lab, k=40).where("selected").collect()]
    assert {*chosen} == {*sorted(keys, key=keys.get)[-40:]}
    good = [rows[d]["selected"] for d, x in labels.items() if x]
    bad = [rows[d]["selected"] for d, x in labels.items() if not x]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3
    keep = {r["doc_id"] for r in importance.keep_selected(frame, lab).collect()}
    assert keep == {d for d, r in rows.items() if r["selected"]}
    k = 17
    few = importance.importance_resample(frame, lab, k=k).where("selected").collect()
    keys = sorted((r["gumbel_key"] for r in rows.values() if r["gumbel_key"] is not None), reverse=True)
    assert len(few) == k and min(r["gumbel_key"] for r in few) == keys[k - 1]


def test_importance_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows = importance.importance_resample(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(not r["selected"] and r["ratio"] is None for r in rows if r["n_ngrams"] == 0)
    assert importance.importance_resample(none, labels).count() == 0
    assert importance.importance_resample(odd, labels.limit(0)).where("selected").count() == sum(r["n_ngrams"] > 0 for r in rows)
    kept = importance.keep_selected(odd, labels)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    assert importance.keep_selected(none, labels).count() == 0


def test_kth_largest(spark):
    values = [*np.random.default_rng(1).integers(-(2**50), 2**50, 500).tolist(), 7, 7, 7]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 250, len(values)):
        assert importance.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


# 3


def test_html_extraction():
    tree = html_extract.trained()
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="home-page"><header><div>Site</div></header><nav><a href=/>Home</a></nav>
    <article><header><h1>The &amp; title</h1></header><p>One <b>bo</b>ld &lt;word&gt;&nbsp;here.<br>Next<p>Second one<script>var x="</p>";</script>
    <div class="ad-box">Buy</div><form><p>Sign up</p></form></article><section id="comments"><p>I disagree with all of this text and say so at length here</p></section>
    <footer>&copy; Us</footer></body></html>"""
    assert html_extract.extract(page, tree) == "The & title One bold <word> here. Next Second one"
    assert html_extract.extract("", tree) == "" and html_extract.extract("<nav>Home", tree) == ""
    assert html_extract.extract("<article><p>cut off &am", tree) == "cut off &am"
    x, y = html_extract.training_table()
    assert (tree.predict(x) == y).mean() > 0.97
    used = set()

    def walk(t):
        if t.feature >= 0:
            used.add(html_extract.FEATURES[t.feature])
            walk(t.left), walk(t.right)

    walk(tree)
    assert used >= {"words", "link_density"} and used & {"words_before", "words_after"} and used & {"link_density_before", "link_density_after"}, used


PROSE = "The tide came in before noon and the boats lay quiet along the wall while the crew ate bread. "


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='menu'><a href=x>DROP</a></div><div class='post-content'><h1>KEEP</h1><p>{PROSE}</p><ul><li>KEEP one</li><li>KEEP</li></ul></div><div class=footer>DROP</div>",
        f"<div class='page has-sidebar'><div id='right_sidebar'>DROP {PROSE}</div><div><h1>KEEP</h1><p>{PROSE}</p><p>KEEP short.</p></div></div>",
        f"<article><h1>KEEP</h1><section id='comments'><p>DROP {PROSE}</p></section></article><div class='comment-list'><div>DROP {PROSE}</div></div>",
        f"<div role='navigation'><a>DROP</a></div><div role='main'><h1>KEEP</h1><p>{PROSE}</p><p><a href=x>KEEP</a></p></div><div role=alert>DROP</div><div class=adBanner>DROP</div>",
        f"<main><table><tr><td>KEEP</td></tr></table><pre>KEEP</pre></main><section class=related-posts><article><p>DROP {PROSE}</p></article></section>",
        "<article><p>KEEP<p>KEEP<!-- DROP",
        "<nav><a href=x>DROP</a></nav><article><p title='a hidden bay'>KEEP</p><p class=tags>KEEP</p><p hidden>DROP</p><p style='display: none'>DROP</p></article>",
        f"<article class=share-price-report><p>KEEP</p><div class=ad-free><p>KEEP</p></div><div class=post-header><h1>KEEP</h1></div><section id=social-impact>KEEP {PROSE}</section><h2 id=related-work>KEEP</h2></article>",
        f"<body class='with-toc toc-page'><div class=share-price-report><h1>KEEP</h1><p>KEEP {PROSE}</p><p>KEEP {PROSE}</p></div></body>",
        f"<a href=a><div>DROP</div></a><a href=b><div>DROP again</div></a><div>KEEP {PROSE}</div><div>KEEP {PROSE}</div><a href=c><div>DROP</div></a>",
        f"<main><script src=x/>DROP</script><p>KEEP</p><style/>DROP</style><svg viewBox='0 0' /><p>KEEP <math><mi>KEEP</mi></math></p></main>",
        f"<div><a href=1>DROP</a> <a href=2>DROP</a></div><h1>KEEP</h1><div>KEEP {PROSE}</div><div>KEEP it rained.</div><div>KEEP {PROSE * 2}</div><div><a href=3>DROP</a></div><div><a href=4>DROP</a></div>",
        f"<h3><a href=1>DROP and other news</a></h3><p>DROP 3 min</p><h3><a href=2>DROP of the day</a></h3><p>KEEP {PROSE * 2}</p><p>KEEP {PROSE}</p><ul><li><a href=3>DROP</a><li><a href=4>DROP</a></ul>",
        "<ul><li><a href=a>DROP</a></li></ul><p>KEEP</p><div class='tags'><a href=x>DROP</a></div>",
    ],
)
def test_html_of_many_shapes(page):
    got = html_extract.extract(page, html_extract.trained())
    assert got.count("KEEP") == page.count("KEEP") and "DROP" not in got


def test_html_on_whole_table(spark):
    got = {r["page_id"]: r for r in html_extract.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    import html

    for i, page in table("pages")[["page_id", "html"]].itertuples(index=False):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        assert got[i]["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p>" * 3000), (2, "u", "<p>" * 3000), (3, "u", "<!-- <article>x"), (4, "u", "<article>" + "<p>word " * 20000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.main_text(frame).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["n_chars"] for r in got}[4] == 5 * 20000 - 1
    assert html_extract.main_text(frame.limit(0)).count() == 0


# 4 and 9


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


def test_bpe_equals_the_library(spark, docs, tokenizer):
    got = result(spark, "op9_bpe")
    for i, t in docs.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("ab \n'<|>endoftx", max_size=60), max_size=5))
def test_bpe_any_text(texts):
    from tokenizers import Tokenizer

    own, other = bpe.encoder(queries.TOKENIZER), token_store.library_encoder(queries.TOKENIZER)
    want = [np.array(Tokenizer.from_file(queries.TOKENIZER).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:1]]
    want += [np.array(other.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[1:]]
    assert own.encode(texts) == want and other.encode(texts) == want
    assert [own.decode(w) for w in want] == texts


def test_bpe_odd_rows(odd, none, tokenizer):
    rows = bpe.encode_decode(odd, queries.TOKENIZER).collect()
    assert len(rows) == odd.count() and bpe.encode_decode(none, queries.TOKENIZER).count() == 0
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] not in (3, 7):
            assert np.frombuffer(r["ids"], "<u4").tolist() == tokenizer.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["decoded"] == (ODD[r["doc_id"]] or "")


def test_token_files(spark, docs, tokenizer):
    got, start = result(spark, "op4_token_files"), 0
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i], add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_odd_rows(spark, odd, none, tokenizer, tmp_path):
    rows = token_store.tokenize_to_files(odd, queries.TOKENIZER, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert token_store.tokenize_to_files(none, queries.TOKENIZER).count() == 0
    files = sorted(p for p in (tmp_path / "ids").iterdir() if p.suffix == ".bits")
    shard = token_store.Shard(files[-1].read_bytes())
    assert shard.bits == 16 and shard.document(shard.documents - 1)[-1] == 0


def test_token_files_of_many_shards(spark, tokenizer, monkeypatch, tmp_path):
    """Null ids and one id that holds a third of all rows are spread over partitions; several shards a partition."""
    monkeypatch.setattr(token_store, "SHARD_BYTES", 300)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, f"text {i} of many") for i in range(300)] + [(-5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    parts = token_store.by_ranges(frame.selectExpr("doc_id AS id", "text", "xxhash64(text) AS tie")).select(F.col("id"), F.spark_partition_id().alias("p"))
    assert parts.where("id IS NULL").select("p").distinct().count() > 1
    got = token_store.tokenize_to_files(frame, queries.TOKENIZER, str(tmp_path / "ids")).orderBy("start").collect()
    assert len(list((tmp_path / "ids").glob("*.bits"))) > 10
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    want = sorted(bytes(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for _, t in rows)
    assert sorted(bytes(r["ids"]) for r in got) == want
    nulls = spark.createDataFrame([(None, f"a{i}") for i in range(40)], "doc_id long, text string")
    assert token_store.by_ranges(nulls.selectExpr("doc_id AS id", "text", "xxhash64(text) AS tie")).select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 5001).astype(np.uint32)
    shard = token_store.Shard(token_store.shard_bytes([1, None], [ids[:5000].astype("<u4").tobytes(), ids[5000:].astype("<u4").tobytes()], bits, 512))
    assert (shard.range(0, 5001) == ids).all() and (shard.range(511, 1030) == ids[511:1030]).all() and len(shard.range(7, 7)) == 0
    assert shard.document(1).tolist() == ids[5000:].tolist()


# 5


def test_media_round_trip(spark, docs):
    got = result(spark, "op5_media_columns")
    for i, t in docs.items():
        raw = t.encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        data = media.mux(payload)
        assert r["media_sha256"] == hashlib.sha256(data).hexdigest() and "codec=twos" in r["feature"]
        keys = [(x["start"], x["size"]) for x in r["key_ranges"]]
        assert (r["codec"], r["duration"]) == ("twos", len(payload) // 192)
        assert [data[a : a + n] for a, n in keys] == [payload[k : k + 192] for k in range(0, len(payload), 192 * media.KEY_EVERY)]
        ranges = np.array(keys, "<i8")
        assert r["feature"] == f"codec=twos;timescale=100;duration={len(payload) // 192};samples={len(payload) // 192};keys={len(keys)};first={','.join(f'{a}+{n}' for a, n in keys[:2])};ranges={zlib.crc32(ranges.tobytes()):08x}"


@pytest.mark.parametrize("n", [1, 7, 15, 16, 17, 32, 33, 500])
def test_media_tables(n):
    payload = np.random.default_rng(n).integers(0, 256, 192 * n).astype(np.uint8).tobytes()
    data = media.mux(payload)
    (track,) = media.tracks(data)
    assert media.payload_of(data, track) == payload and track.duration == n and track.codec == "twos"
    for k in track.keys.tolist():
        assert data[track.offsets[k] : track.offsets[k] + track.sizes[k]] == payload[192 * k : 192 * (k + 1)]
    assert [b.path[-1] for b in media.walk(data)][:3] == [b"ftyp", b"moov", b"mvhd"]


def test_media_odd_rows(spark, odd, none):
    rows = media.media_columns(odd).collect()
    assert len(rows) == odd.count() and media.media_columns(none).count() == 0
    assert {r["payload_bytes"] for r in rows if r["doc_id"] in (0, 1)} == {192}
    broken = spark.createDataFrame([(1, 1, b"junk"), (2, 2, None), (3, 3, media.mux(b"x" * 192)[:200])], "doc_id long, n_bytes long, media binary")
    assert [r["codec"] for r in media.probe(broken).collect()] == [None] * 3
    nested = b""
    for _ in range(5000):
        nested = media.box(b"moov", nested)
    huge = media.mux(b"x" * 192).replace((192).to_bytes(4, "big") + (1).to_bytes(4, "big"), (192).to_bytes(4, "big") + (2**32 - 1).to_bytes(4, "big"))
    assert len([*media.walk(nested)]) == media.DEPTH
    odd_files = spark.createDataFrame([(1, 1, nested), (2, 2, huge)], "doc_id long, n_bytes long, media binary")
    assert [(r["codec"], r["media_bytes"]) for r in media.probe(odd_files).orderBy("doc_id").collect()] == [(None, len(nested)), (None, len(huge))]


# 6


def test_language_held_out_accuracy(spark):
    got = result(spark, "op6_language_id")
    lang = dict(table("documents")[["doc_id", "lang"]].itertuples(index=False))
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    test = [r["lang_pred"] == lang[i] for i, r in got.items() if r["held_out"] and lang[i]]
    assert len(test) > 20 and np.mean(test) > 0.97


def test_language_of_words_in_mixed_text(spark):
    field = language_id.fit_on(spark.read.parquet(f"{SF}/documents.parquet"))
    d = table("documents")
    a, b = (d[d.lang == x].text.iloc[3].split()[:60] for x in ("de", "es"))
    w, p = language_id.word_labels(field, [" ".join(a + b).encode()])
    best = [field.labels[i] for i in p.argmax(axis=1)]
    half = len(words(" ".join(a)))
    assert np.mean([x == "de" for x in best[:half]]) > 0.9 and np.mean([x == "es" for x in best[half:]]) > 0.9


def test_documents_in_several_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = language_id.fit_on(docs)
    d = table("documents")
    langs = sorted(x for x in d.lang.dropna().unique())
    mixed = " ".join(" ".join(d[d.lang == x].text.iloc[3].split()[:50]) for x in langs)
    w, p = language_id.word_labels(field, [mixed.encode()])
    names, scores, sure = language_id.classify(field, [mixed.encode(), b"12 34"])
    assert abs(sure[0] - p.max(axis=1).mean()) < 1e-9 and scores[0] == pytest.approx(p.mean(axis=0).max()) and (names[1], sure[1]) == ("und", 0.0)
    rows = spark.createDataFrame([(1, mixed), (2, "12 34"), (3, None)], "doc_id long, text string")
    assert scores[0] < 0.5 and [r["doc_id"] for r in language_id.keep_identified(rows, field).collect()] == [1]


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    emit, move = rng.standard_normal((9, 3)), rng.standard_normal((3, 3))
    first = np.array([0, 4, 4, 5, 9])
    got, moves = language_id.marginals(emit, first, move)
    want, want_moves = np.zeros((9, 3)), np.zeros((3, 3))
    for s, e in zip(first[:-1], first[1:], strict=True):
        paths = [*product(range(3), repeat=int(e - s))]
        score = np.array([np.exp(sum(emit[s + i, y] for i, y in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:], strict=False))) for p in paths])
        for p, v in zip(paths, score / score.sum(), strict=True):
            for i, y in enumerate(p):
                want[s + i, y] += v
            for x, y in zip(p, p[1:], strict=False):
                want_moves[x, y] += v
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_language_odd_rows(odd, none):
    field = language_id.fit_on(odd)
    rows = language_id.language_id(odd, field).collect()
    assert len(rows) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2, 9))
    assert language_id.keep_identified(odd, field).columns == odd.columns
    nothing = language_id.fit_on(none)
    assert {r["lang_pred"] for r in language_id.language_id(odd, nothing).collect()} == {"und"} and language_id.language_id(none, field).count() == 0


# 7


def brute_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: id -> fingerprint."""
    parent = {f: f for f in fps.values()}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = [*parent]
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 2**62)
    for i, f in fps.items():
        least[find(f)] = min(least[find(f)], i)
    return {i: least[find(f)] for i, f in fps.items()}


def test_simhash_against_brute_force(spark, docs):
    got = result(spark, "op7_simhash")
    fps = {i: brute_simhash(t) for i, t in docs.items()}
    want = brute_components(fps)
    for i in docs:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fps[i]:016x}", want[i])


@pytest.mark.parametrize(("pairwise", "often"), [(1, 256), (2, 2), (256, 1), (256, 256)])
def test_links_of_dense_fingerprints(spark, pairwise, often):
    rng = np.random.default_rng(pairwise + often)
    fps = {}
    for _ in range(6):
        centre = int(rng.integers(0, 2**63))
        fields = rng.choice(64, 9, replace=False)
        for _ in range(30):
            fps[len(fps) * 3 + 5] = centre ^ int(sum(1 << int(b) for b in rng.choice(fields, rng.integers(0, 5), replace=False)))
    signed = {i: f - 2**64 if f >= 2**63 else f for i, f in fps.items()}
    least = {}
    for i, f in signed.items():
        least[f] = min(i, least.get(f, i))
    edges = simhash.links(spark.createDataFrame([(r, f) for f, r in least.items()], "rep long, fp long"), pairwise, often)
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    want = brute_components(fps)
    assert {i: found.get(least[signed[i]], least[signed[i]]) for i in fps} == want


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(none).count() == 0
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["fingerprint"] for r in rows if r["doc_id"] == 0} == {"0" * 16}
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    stay = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept.withColumn("text", F.coalesce("text", F.lit(""))).collect())
    assert [i for i, _ in stay] == [-1, 0, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11]  # two texts of id 7, one of the two equal rows of id 3


def test_sketches_measure_similarity():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    one = list(rng.choice(words, 1500))
    texts = [one, one[:1200] + list(rng.choice(words, 170)), one[:700], ["a", "b"], ["a", "b"], [], list(rng.choice(words, 1500))]
    texts = [" ".join(t).encode() for t in texts]
    found = simhash.shingle_sets(simhash.Words(texts, simhash.NOT_SPACE))
    got = np.unpackbits(found.sketch.view(np.uint8), axis=1)
    sets = [{*simhash.shingles(t, 5)} for t in texts]
    for a, b in ((0, 1), (0, 2), (0, 6), (3, 4), (1, 2)):
        truth = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert abs(1 - 2 * np.mean(got[a] != got[b]) - truth) < 0.12, (a, b)
    assert (got[3] == got[4]).all() and not got[5].any()
    assert found.size.tolist() == [len(x) for x in sets] and (found.keys[3] == found.keys[4]).all() and not (found.keys[0] == found.keys[2]).all()
    assert simhash.shingle_sets(simhash.Words([], simhash.NOT_SPACE)).sketch.shape == (0, simhash.SKETCH)


def test_proposals_grow_with_the_nodes(spark):
    """One list of all nodes, and a crowd in which all hang on one text: few pairs, and each with the hub."""
    rows = [(i, [7] + [1000 + i % 20, 5000 + i]) for i in range(400)] + [(400, [7, *range(1000, 1020)])]
    for often in (1, 256):
        pairs = {tuple(r) for r in simhash.proposals(spark.createDataFrame(rows, "rep long, keys array<long>"), often).collect()}
        assert {(400, i) for i in range(400)} <= pairs and len(pairs) < 4 * 400


@pytest.mark.parametrize("often", [1, 256])
def test_wide_links_find_near_copies(spark, often, monkeypatch):
    monkeypatch.setattr(simhash, "wide_links", lambda nodes, grams, f=simhash.wide_links: f(nodes, grams, often))
    rng = np.random.default_rng(often)
    word = lambda: "".join(rng.choice(list("abcdefghijklmno"), 5))
    rows, group = [], {}
    for g in range(12):
        base = [word() for _ in range(250)]
        for _ in range(int(rng.integers(1, 20))):
            copy = base.copy()
            for i in rng.choice(250, int(rng.integers(0, 4)), replace=False):
                copy[i] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    five = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    assert all(len(five(rows[a][1].split()) & five(rows[a + 1][1].split())) >= 0.75 * 246 for a in range(len(rows) - 1) if group[a] == group[a + 1])
    got = {r["doc_id"]: r["component_id"] for r in simhash.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in group.items()}


def brute_groups(texts):
    """texts: id -> text. Groups by fingerprints within two bits, or 4/5 of five-word shingles in common; each one's smallest id."""
    ids, fps = [*texts], {i: brute_simhash(t) for i, t in texts.items()}
    sets = {i: {*simhash.shingles((t or "").encode(), 5)} for i, t in texts.items()}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("often", [1, 256])
def test_copy_groups_against_brute_force(spark, often, monkeypatch):
    """Copies of all similarities around the limit, short and long."""
    monkeypatch.setattr(simhash, "wide_links", lambda nodes, grams, f=simhash.wide_links: f(nodes, grams, often))
    rng = np.random.default_rng(often)
    word = lambda: "".join(rng.choice(list("abcdefghijklmno"), 5))
    texts = []
    for size in (1, 3, 6, 12, 40, 100, 300, 300, 1000):
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(30):
            copy = base.copy()
            for i in rng.choice(size, min(size, int(rng.integers(0, max(2, size // 25)))), replace=False):
                copy[i] = word()
            texts.append(" ".join(copy[int(rng.integers(0, 2)) :]))
    texts = {int(i): t for i, t in zip(rng.permutation(len(texts)), texts, strict=True)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.copy_groups(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    want = brute_groups(texts)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is joined that is not a copy
    assert np.mean([got[i] == want[i] for i in texts]) > 0.98 and 12 < len({*got.values()}) < len(texts) / 2


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = "the tide came in before noon and the boats lay quiet along the wall", "rope and bread were sold at the corner of the old market every day"
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (3, b, 3), (4, "one", 4), (4, "one", 5), (None, "two", 6), (None, "two", 7), (None, a, 8)]
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()
    assert sorted(r["text"] for r in kept) == sorted([a, b, "one", "two"])
    assert {r["key"] for r in kept} >= {0, 2}


def test_copies_in_a_crowd_are_linked(spark):
    """All texts share most of a passage with each other, and the copy of each lies 300 ids on."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmno"), 6))

    def changed(words, k):
        words = words.copy()
        for i in rng.choice(len(words), k, replace=False):
            words[i] = word()
        return words

    passage, n = [word() for _ in range(250)], 300
    texts = [changed(passage, 12) for _ in range(n)]
    texts += [changed(t, 4) for t in texts]
    sets = [{*simhash.shingles(" ".join(t).encode(), 5)} for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(i, n + i) > 0.8 for i in range(n)) and max(alike(i, j) for i in range(n) for j in range(i)) < 0.7
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(n) if got[i] != got[n + i]] == [] and len({*got.values()}) > n / 2


@pytest.mark.parametrize("often", [1, 256])
def test_copies_in_a_crowd_just_below_the_limit_are_linked(spark, often, monkeypatch):
    """Most keys of a text are shared with more than LIST others that are near it, but not near enough: every pair at 4/5 is found all the same, and no other."""
    monkeypatch.setattr(simhash, "wide_links", lambda nodes, grams, f=simhash.wide_links: f(nodes, grams, often))
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefghijklmno"), 6))

    def changed(words, k):
        words = words.copy()
        for i in rng.choice(len(words), k, replace=False):
            words[i] = word()
        return words

    passage, n = [word() for _ in range(250)], 300
    texts = [changed(passage, 4) for _ in range(n)]
    texts += [changed(t, 4) for t in texts]
    sets = [{*simhash.shingles(" ".join(t).encode(), 5)} for t in texts]
    linked = {(i, j) for i in range(2 * n) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    parent = [*range(2 * n)]
    fps = [brute_simhash(" ".join(t)) for t in texts]
    linked |= {(i, j) for i in range(2 * n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}
    for _ in range(2 * n):
        before = [*parent]
        for i, j in linked:
            parent[i] = parent[j] = min(parent[i], parent[j])
        if parent == before:
            break
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(2 * n) if got[i] != parent[i]] == [] and len({*parent}) > 50


@pytest.mark.parametrize("bits", [1 << 25, 1 << 4])
def test_rows_are_parted_by_keys_whole(spark, bits, monkeypatch):
    """However full the map is, no row is lost and only rows without a key are taken out of the join."""
    monkeypatch.setattr(common, "MAP_BITS", bits)
    df = spark.range(3000).selectExpr("id", "id % 7 AS key", "'x' AS map_at", "null AS MAP_BITS")
    keys = spark.createDataFrame([(i,) for i in range(0, 4000, 9)], "id long")
    some, others = common.parted_by_keys(df, F.col("id"), keys)
    assert some.columns == others.columns == df.columns
    some, others = ([r["id"] for r in x.collect()] for x in (some, others))
    assert sorted(some + others) == [*range(3000)] and {*range(0, 3000, 9)} <= {*some} and (len(some) < 400 or bits < 100)
    assert sorted(r["id"] for r in common.without_keys(df, F.col("id"), keys).collect()) == [i for i in range(3000) if i % 9]
    assert common.without_keys(df, F.col("id"), keys.limit(0)).count() == 3000 and common.without_keys(df.limit(0), F.col("id"), keys).count() == 0


def test_passing_tables_are_deleted(spark, docs):
    def tables():
        folder = common.checkpoint_dir(spark).removeprefix("file:")
        return {x.split("-")[0] for x in os.listdir(folder)} if os.path.isdir(folder) else set()

    with common.passing_tables(spark):
        gone = common.stored(spark.range(3), "gone")
        stays = common.stored(gone, "stays", keep=True)
        assert gone.count() == 3 and {"gone", "stays"} <= tables()
    assert stays.count() == 3 and "gone" not in tables() and "stays" in tables()


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(300, 380)] + [(0, int(x)) for x in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(400, 500, (60, 2))] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert found == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8


def brute_overlap(docs, items, window=13):
    wins = {}
    for j, t in items.items():
        w = words(t)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(j))
    sizes = {len(x) for x in wins}
    out = {}
    for i, t in docs.items():
        w, hit, names = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    names |= found
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def brute_matches(docs, items, window):
    """Of each document: maximal matches (item, word of the item, word, words) that begin with a window."""
    out = {}
    for i, t in docs.items():
        w, found = words(t), []
        for j, item in items.items():
            v = words(item)
            for a in range(len(v)):
                for p in range(len(w)):
                    if v[a] == w[p] and not (a and p and v[a - 1] == w[p - 1]):
                        k = next((k for k in range(min(len(v) - a, len(w) - p)) if v[a + k] != w[p + k]), min(len(v) - a, len(w) - p))
                        if k >= min(window, len(v)):
                            found.append((str(j), a, p, k))
        out[i] = sorted(found)
    return out


def test_words_are_compared_byte_by_byte(monkeypatch):
    """With hashes that collide, results stay the same."""
    monkeypatch.setattr(Words, "hashes", lambda self, seed=0: np.where(self.lengths % 2 == 0, 7, self.lengths).astype(np.uint64) if not seed else hash_spans(self.data, self.starts, self.lengths, seed))
    items = decontaminate.prepare([1], [b"one two three four"], 2)
    assert items.seed == 1
    items = decontaminate.prepare([1], [b"a bb"], 2)
    found = decontaminate.search_shard(Words([b"x bb", b"a bb", b"a cccc"]), iter([items]))
    assert found.longest.tolist() == [0, 2, 0]


def test_a_passage_in_a_long_text_goes(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, "plain words " * 3000), (2, "plain words " * 3000 + passage + " more" * 4000), (3, None)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()] == [1, 3]


def test_decontamination_against_brute_force(spark, docs):
    got = result(spark, "op8_decontaminate")
    want = brute_overlap(docs, dict(table("benchmark")[["item_id", "text"]].itertuples(index=False)))
    assert {i: tuple(r.values())[1:] for i, r in got.items()} == want and any(x[4] for x in want.values())


@pytest.mark.parametrize("block", [10, 1 << 20])
def test_decontamination_small_alphabet(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = np.random.default_rng(block)
    text = lambda n: " ".join(rng.choice(list("abc"), n)) + ("." if n % 2 else "")
    docs = {i: text(int(rng.integers(0, 60))) for i in range(40)} | {40: None, 41: "a a a a a a"}
    items = {i: text(n) for i, n in enumerate([0, 1, 3, 5, 6, 9, 14])} | {9: None, 10: "a a a"}
    frame = spark.createDataFrame([*docs.items(), (None, docs[41])], "doc_id long, text string")
    test = spark.createDataFrame([*items.items()], "item_id long, text string")
    found = decontaminate.overlaps(frame, test, window=5)
    got = {r[0]: tuple(r)[1:6] for r in decontaminate.contamination(found).collect()}
    own = got.pop(None)
    want = brute_overlap(docs, items, 5)
    assert got == want and own == want[41]
    bad = {i for i, x in want.items() if x[1]}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(frame, test, window=5).where("doc_id IS NOT NULL").collect()) == sorted({*docs} - bad)
    places = brute_matches(docs, items, 5)
    for r in found.where("doc_id IS NOT NULL").collect():
        assert sorted(map(tuple, r["locations"])) == places[r["doc_id"]] and r["longest"] == max((x[3] for x in places[r["doc_id"]]), default=0)
    longest = {j: 0 for j in items}
    for t in docs.values():
        for j, item in items.items():
            longest[j] = max(longest[j], max((x[3] for x in brute_matches({0: t}, {j: item}, 1)[0]), default=0))
    rows = {r["item_id"]: r for r in decontaminate.longest_matches(frame, test).collect()}
    assert {j: rows[str(j)]["words"] if str(j) in rows else 0 for j in items} == longest
    for j, r in rows.items():
        w, item = words(docs.get(r["doc_id"], docs[41])), words(items[int(j)])
        assert w[r["word"] : r["word"] + r["words"]] == item[r["item_word"] : r["item_word"] + r["words"]]
    assert decontaminate.overlaps(frame, test.limit(0)).where("longest > 0").count() == 0
    assert decontaminate.overlaps(frame.limit(0), test).count() == 0


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "x y " + " ".join(f"w{i}" for i in range(5, 31)) + " z"), (2, " ".join(f"w{i}" for i in range(12)))]
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r["doc_id"]: (r["longest"], r["spans"]) for r in got.collect()} == {1: (26, [2, 28]), 2: (0, [])}


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "mit license"), (None, "dolor lorem ipsum"), (2, None)], "item_id long, text string")
    rows = decontaminate.contamination(decontaminate.overlaps(odd, items)).collect()
    assert len(rows) == odd.count() and {r["doc_id"]: r["n_hit"] for r in rows}[8] == 3 * 30_000 - 3
    kept = decontaminate.decontaminated(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({4, 8})


def test_words_are_encoded_in_short_runs(monkeypatch):
    """The library never gets more than 1,024 words at once, and ids are those of whole texts, at the starts of texts and lines too."""
    own, given = token_store.LibraryEncoder(queries.TOKENIZER), []
    whole = own.encode_flat
    monkeypatch.setattr(own, "encode_flat", lambda text: given.append(text) or whole(text))
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh .\n\té"), 6)).strip() or "x" for _ in range(5000)]
    texts = [" ".join(words), "\n".join(words[:50]), "x", "", " ", "x y", "\nx  y\t", words[7] + "\n" + words[7] + " " + words[7]]
    for _ in range(2):
        got = [np.frombuffer(c, "<u4").tolist() for c in own.encode(texts)]
        assert got == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(t.count(" ") + t.count("\n") for t in given if t not in texts) <= 1024


# 10


def brute_log_prob(p, classes, text):
    """Log-probabilities of the tokens of a text, one by one."""
    t, _ = pseudo_likelihood.tokens([text.encode()])
    k, out = pseudo_likelihood.WINDOW, []
    number = lambda i: min(int(t[i]) >> (pseudo_likelihood.TOKEN_BITS - pseudo_likelihood.INPUT_BITS), pseudo_likelihood.EDGE - 1) if 0 <= i < len(t) else pseudo_likelihood.EDGE
    for i in range(len(t)):
        left = sum(p["left"][number(i - k + j)].astype(float) * p["place"][j] for j in range(k))
        right = sum(p["right"][number(i + 1 + j)].astype(float) * p["place"][k + j] for j in range(k))
        h = np.tanh(np.concatenate([left, right]) @ p["hidden"] + p["bias"][0])
        z = h @ p["out"] + p["out_bias"][0]
        c = classes.of[t[i]]
        own = z[c] - np.log(np.exp(z).sum())
        m = np.flatnonzero(classes.of == c)
        z = p["member"][m] @ h + classes.log_share[m]
        out.append(own + z[m == t[i]][0] - np.log(np.exp(z).sum()))
    return out


def test_lm_score(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in pseudo_likelihood.lm_score(frame).collect()}
    p, classes = pseudo_likelihood.fit(frame.selectExpr("doc_id AS id", "text"))
    for i in sorted(docs, key=lambda i: len(docs[i]))[::9][:15]:
        each = brute_log_prob(p, classes, docs[i])
        assert got[i]["n_tokens"] == len(each) and abs(got[i]["log_prob"] - sum(each)) < 1e-4 * max(1, len(each))
    counts, total, score = Counter(), 0, 0.0
    for i, t in docs.items():
        t_, w = pseudo_likelihood.tokens([t.encode()])
        assert got[i]["n_tokens"] == len(t_)
        counts.update(t_.tolist())
        total, score = total + len(t_), score + got[i]["log_prob"]
    alone = sum(n * np.log(n / total) for n in counts.values()) / total
    assert score / total > alone  # both sides tell more than a token's own frequency
    assert all(r["log_prob"] < 0 for r in got.values() if r["n_tokens"])
    again = {r["doc_id"]: r["log_prob"] for r in pseudo_likelihood.lm_score(frame.repartition(7)).collect()}
    assert all(abs(again[i] - r["log_prob"]) <= 1e-4 * max(1, r["n_tokens"]) for i, r in got.items())


def test_lm_gradient():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, pseudo_likelihood.TOKENS)
    classes = pseudo_likelihood.make_classes(counts)
    assert len(np.unique(classes.of)) == pseudo_likelihood.CLASSES
    assert np.allclose(np.bincount(classes.of, np.exp(classes.log_share), pseudo_likelihood.CLASSES), 1)
    p = pseudo_likelihood.initial(counts, rng.integers(0, 5, (2, pseudo_likelihood.INPUTS, pseudo_likelihood.CLASSES)), classes)
    p = {k: v.astype(float) for k, v in p.items()}
    text = ("the cat sat on the mat and the dog sat on the log " * 4).encode()
    t, w = pseudo_likelihood.tokens([text, b"", b"a"])
    x = pseudo_likelihood.windows(t, w)
    assert (x[-1] == pseudo_likelihood.EDGE).all() and (x[0, :3] == pseudo_likelihood.EDGE).all()
    p["member"][t] = rng.standard_normal((len(t), pseudo_likelihood.HIDDEN)) * 0.1
    g = pseudo_likelihood.Gradient(p)
    g.add(p, classes, x, t)
    score = lambda q: pseudo_likelihood.log_probs(q, classes, t, w).sum()
    for k in p:
        at = np.unravel_index(np.abs(g.sums[k]).argmax(), p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert abs((score(up) - score(down)) / 2e-4 - g.sums[k][at]) < 1e-2 * max(1, abs(g.sums[k][at])), k
    assert (pseudo_likelihood.Gradient(p).load(g.flat()).flat() == g.flat()).all()


def test_lm_trains_on_every_document(spark):
    """Every document's own words move weights, however short it is."""
    texts = [(i, f"word{i}" + f" and other{i}" * i) for i in range(40)]
    p, classes = pseudo_likelihood.fit(spark.createDataFrame(texts, "id long, text string"))
    for _, x in texts:
        t = pseudo_likelihood.tokens([x.encode()])[0]
        assert p["member"][t].any() or (np.isin(classes.of[t], np.arange(pseudo_likelihood.OWN))).any()


def test_lm_targets_are_all_tokens(spark):
    """A round's gradient is that of all tokens of its documents, none left out."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50, n)).encode() for n in (0, 1, 2, 5, 30, 400, 7)]
    frame = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(texts)], "id long, text string")
    t, w = pseudo_likelihood.tokens(texts)
    counts = np.bincount(t, minlength=pseudo_likelihood.TOKENS)
    classes = pseudo_likelihood.make_classes(counts)
    p = pseudo_likelihood.initial(counts, np.zeros((2, pseudo_likelihood.INPUTS, pseudo_likelihood.CLASSES), np.int64), classes)
    want = pseudo_likelihood.Gradient(p)
    want.add(p, classes, pseudo_likelihood.windows(t, w), t)
    got = pseudo_likelihood.gradient(pseudo_likelihood.training_tokens(frame, 3).select("tokens", "counts"), p, classes)
    assert got.served["all"][0] == len(t) and np.allclose(got.flat(), want.flat(), atol=1e-3)


def test_lm_odd_rows(odd, none):
    rows = pseudo_likelihood.lm_score(odd, rounds=1).collect()
    assert len(rows) == odd.count() and pseudo_likelihood.lm_score(none).count() == 0
    assert all(r["log_prob"] == 0 and r["mean_log_prob"] is None for r in rows if r["n_tokens"] == 0)


# all


def test_oracle_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF).toPandas()
        want = con.sql(sql).df()[got.columns.tolist()]
        key = got.columns[0]
        assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str)), name
