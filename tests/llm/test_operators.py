import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomline.llm import html_text, license_sql, mixing, quality, sharding, vector_dedup
from loomline.llm.common import connected_components
from loomline.llm.license_scan import TEMPLATES, license_scan
from loomline.llm.piece_codec import Codec, Normalizer, default_model, piece_codec, read_charsmap
from loomline.llm.token_counts import UnitCounter, default_tokenizer, token_counts

ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\nline", "é日本 😀 ﬁ ①", "\x00\x1c\x85", "▁▁x▁", "<|endoftext|> <s>", "it's 12½!!",
    "word " * 400, "Licensed under CC BY-NC 4.0.", "cc-by CC BY cc  by", "All rights\nreserved", "acc by reserved all rights",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof it", "released under the MIT license",
    "GNU General Public License general public license", "KK cc by all rights reserved ",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, a repeated and a null id, and columns with names that operators use."""
    rows = [(i, t, "s", 1, "x") for i, t in enumerate(ODD)] + [(3, "a", "s", 1, "x"), (3, "other", None, 2, "y"), (None, "a b", "z", 0, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, labels string")


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (5, 5)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in parent}


def test_license_scan_equals_sql(spark, odd):
    got = license_scan(odd).toPandas()
    con = duckdb.connect()
    con.register("documents", odd.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(license_sql.sql()).df()
    norm = lambda rows: sorted(([float(x) if isinstance(x, int | float) else x for x in r] for r in rows), key=repr)
    clean = lambda df: [[None if x is None or x != x else x for x in r] for r in df[sorted(df)].astype(object).where(df[sorted(df)].notna(), None).values.tolist()]
    assert norm(clean(got)) == norm(clean(want))
    assert license_scan(odd.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, odd, tmp_path):
    counter = UnitCounter(default_tokenizer(), max_units=20)
    whole = lambda ts: [len(x.ids) for x in counter.tokenizer.encode_batch(ts, add_special_tokens=False)]
    r = random.Random(2)
    texts = ["".join(r.choice([*"ab 1'!\n\té", "  ", "the ", "<|endoftext|>", " x"]) for _ in range(r.randint(0, 40))) for _ in range(800)]
    assert counter.cuttable and counter.count(texts) == whole(texts)
    cache = str(tmp_path / "cache")
    first = token_counts(odd, cache_path=cache).collect()
    assert Counter((x.doc_id, x.n_tokens) for x in first) == Counter(
        (x.doc_id, n) for x, n in zip(odd.collect(), whole([x.text or "" for x in odd.collect()]), strict=True)
    )
    assert all(x.over_limit == (x.n_tokens > 1024) for x in first)
    again = token_counts(odd, cache_path=cache)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, first))
    version = next((tmp_path / "cache").iterdir())
    assert spark.read.parquet(str(version)).count() == len({x.text or "" for x in odd.collect()})
    assert token_counts(odd.limit(0)).count() == 0


def library_spans(codec, text):
    found = codec.library.encode(text, return_type="proto")
    return [(p.id, p.begin, p.end) for p in found.pieces]


def spans(codec, texts):
    ids, begin, end, at = codec.encode(texts)
    return [list(zip(ids[a:b].tolist(), begin[a:b].tolist(), end[a:b].tolist(), strict=True)) for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("rule,strip,suffix", [(None, False, False), ("nmt_nfkc", True, False), ("nfkc", False, False), ("nmt_nfkc", True, True)])
def test_pieces_and_spans_equal_the_library(rule, strip, suffix):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(default_model(), "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    if rule:
        spec = pb.NormalizerSpec.FromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
        model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
        assert read_charsmap(spec.precompiled_charsmap)["ﬁ".encode()] == b"fi"
    model.normalizer_spec.remove_extra_whitespaces = strip
    model.trainer_spec.treat_whitespace_as_suffix = suffix
    codec = Codec(proto=model.SerializeToString(), max_units=30)
    r = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "ﬁ", "①", "¨", "▁", "日本", "😀", "\x00", "　", "<s>", "12", "鿿", "\x1c", "Ａ"]
    texts = [t or "" for t in ODD] + ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)]
    assert spans(codec, texts) == [library_spans(codec, t) for t in texts]
    assert isinstance(codec.normalizer, Normalizer)


def test_piece_codec_of_documents(spark, odd):
    codec = Codec()
    got = piece_codec(odd).collect()
    want = Counter()
    for x in odd.collect():
        ids = codec.library.encode(x.text or "")
        want[(x.doc_id, tuple(ids), codec.library.decode(ids))] += 1
    assert Counter((x.doc_id, tuple(x.ids), x.decoded) for x in got) == want
    assert piece_codec(odd.limit(0)).count() == 0


def test_sharding(spark, odd):
    r = random.Random(4)
    texts = ["copy of one text " * 3] * 700 + [f"{'w ' * r.randint(1, 400)}{i}" for i in range(1300)] + [None, "", "x" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = sharding.shard(df, n=24).collect()
    assert len(got) == df.count()
    rows, size, at = Counter(), Counter(), defaultdict(set)
    texts_of = defaultdict(set)
    by_id = {x.doc_id: x.text for x in df.collect()}
    for x in got:
        assert 0 <= x.shard < 24 and x.slot not in at[x.shard]
        at[x.shard].add(x.slot)
        rows[x.shard] += 1
        size[x.shard] += x.size
        if x.doc_id is not None and x.doc_id >= len(ODD):
            raw = (by_id[x.doc_id] or "").encode()
            assert x.size == len(raw) + 8 and x.text_crc32 == zlib.crc32(raw)
            texts_of[by_id[x.doc_id] or ""].add(x.shard)
    assert all(at[s] == set(range(rows[s])) for s in at)
    mean = sum(size.values()) / 24
    assert max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    assert {len(s) for t, s in texts_of.items() if t != texts[0]} == {1} and len(texts_of[texts[0]]) > 1
    assert sorted(map(repr, sharding.shard(df, n=24).collect())) == sorted(map(repr, got))
    assert sharding.shard(df.limit(0)).count() == 0


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    need, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = need / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] < level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            need -= out[s]
        free -= full
    return out


def test_mixing(spark, odd):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["b", "b", "b", "a", "c", "é", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").union(odd.select("doc_id", "text", "source"))
    got = mixing.mix(df, keep=("doc_id", "source")).collect()
    assert len(got) == df.count()
    sizes, taken = Counter(), Counter()
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size
        assert (x.position is None) == (x.taken == 0) and (x.position is None or 0 <= x.position <= 1)
        assert len(x.positions or []) == x.passes
    want = water_fill(sizes)
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 * want[x.source] + 1e-9
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows if i >= len(ODD)}
    assert all(x.size == words[x.doc_id] for x in got if x.doc_id in words)
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_position_inverts_the_demand(spark):
    from pyspark.sql import functions as F

    rows = [(x / 10, t) for x in range(11) for t in (-0.5, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "y double, tilt double").withColumn("t", mixing.position(F.col("y") * 70, F.lit(70.0), F.col("tilt")))
    for x in df.collect():
        assert abs((1 - x.tilt) * x.t + x.tilt * x.t * x.t - x.y) < 1e-12


def test_quality(spark, odd):
    r = random.Random(6)
    words = [f"{a}{b}" for a in ("lo", "mi", "tra", "ne") for b in ("sa", "ri", "ton", "vel", "a")]
    good = lambda: " ".join(r.choice(words) for _ in range(40)).capitalize() + "."
    bad = lambda: " ".join(r.choice(words) + r.choice(["%%%", "***"]) for _ in range(40))
    rows = [(i, good() if i % 4 else bad(), i % 4 > 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t, _ in rows], "doc_id long, text string, score double, held_out int")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs.union(odd.selectExpr("doc_id + 1000", "text", "0.5", "1")), model).collect()
    truth = {i: int(y) for i, _, y in rows}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 80 and sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    constant = quality.train(docs, labels.where("quality = 1"))
    assert {x.predicted for x in quality.score(docs.limit(5), constant).collect()} == {1}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


PAGES = [
    (None, ""),
    ("", ""),
    ("Plain text", "Plain text"),
    (
        "<body><header>Site</header><nav><a href=x>a</a></nav><article><header><h1>Title</h1></header><p>Hello &amp; <b>bo</b>ld"
        "<i>x</i>.<p>Second<br>line<ul><li>one<li>two</ul><aside>see also</aside><div class='comments'><p>first!</p></div><p>End"
        "</article><aside>side</aside><div id=cookie-notice>We use</div><form>f</form><footer>&copy;</footer>",
        "Title Hello & boldx. Second line one two End",
    ),
    ("<div><p>a &lt; b &#233; &nbsp; c</p><script>var t='</p>'</script></div>", "a < b é c"),
    ("<article><p>cut <b", "cut"),
    ("<article>5 < 6 <!-- no --> <span hidden>x</span></article>", "5 < 6"),
    ("<div class=menu><ul><li><a href=a>Home</a></ul></div><main><p>" + "the man of the house and the sea " * 8 + "</p></main>", ("the man of the house and the sea " * 8).strip()),
]


def test_html(spark):
    for html, want in PAGES:
        assert html_text.main_text(html) == want
    df = spark.createDataFrame([(i, "u", h, 3) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {x.page_id: x for x in html_text.extract(df).collect()}
    assert all(got[i].text == w and got[i].n_chars == len(w) for i, (_, w) in enumerate(PAGES))
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_without_marks_follows_density():
    text = "<p>{}</p>"
    body = "It was the end of the day and the man had to be at the house that was on the hill, so he went with her there. " * 3
    page = (
        "<div><a href=1>Home page</a> <a href=2>News page</a></div>" + text.format(body) + text.format("A short one.") + text.format(body)
        + "<div><a href=3>Next page</a></div>"
    )
    assert html_text.main_text(page) == " ".join([body.strip(), "A short one.", body.strip()])


def test_vectors(spark):
    g = np.random.default_rng(7)
    base = g.standard_normal((300, 16))
    near = np.concatenate([base[:40] + 0.1 * g.standard_normal((40, 16)) for _ in range(3)] + [base[0] + 0.05 * g.standard_normal((60, 16))])
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, x[5].tolist(), 1), (n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] * 16, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, leaf=64).collect()}
    assert len(got) == len(rows)
    u = np.concatenate([x, x[5:6]]).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    found = np.array([got[i].n_links for i in range(n + 1)])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    label = np.arange(n + 1)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n + 1).min(1))
        if (new == label).all():
            break
        label = new
    assert np.mean([got[i].component_id == label[i] for i in range(n + 1)]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in range(n + 1))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n + 1, n + 7))
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "z", 0)], docs.schema))
    kept = C.keep_good(spark, docs, sf)
    assert kept.columns == docs.columns
    found = {x.doc_id for x in kept.collect()}
    assert np.mean([(i in found) == (q == 1) for i, q in labels.items()]) > 0.9
    one = C.keep_one_of_each_group(spark, kept, sf)
    assert one.columns == docs.columns and one.count() == one.select("doc_id").distinct().count() <= kept.count()
    mixed = C.mix_sources(spark, one, sf)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() <= one.count()
    plan = {x.doc_id: x.passes for x in mixing.mix(one).collect()}
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({k: v for k, v in plan.items() if v})
    codec = Codec()
    texts = {x.doc_id: x.text or "" for x in mixed.collect()}
    coded = C.encode(spark, mixed, sf).collect()
    assert len(coded) == mixed.count()
    for x in coded[:40]:
        ids = codec.library.encode(texts[x.doc_id])
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
    assert C.run(spark, sf).count() > 0


def test_license_notices_wrapped_over_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:"
    gpl = (
        "dnl This program is free software; you can redistribute it and/or modify\ndnl it under the terms of the GNU General Public License as published by\n"
        "dnl the Free Software Foundation, either version 2"
    )
    far = mit.replace("\n", " filler" * 60 + "\n")
    cut = "hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"
    texts = [mit, bsd, gpl, far, cut, "word " * 3000 + gpl + " word" * 3000, mit + "\n\n" + bsd]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(df).collect()}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert got == {i: (labels, score) for i, labels, score in con.execute(f"select doc_id, labels, score from ({license_sql.sql()})").fetchall()}
    assert got == {
        0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("gpl,gpl-notice", 1.0), 3: ("", 0.0), 4: ("", 0.0), 5: ("gpl,gpl-notice", 1.0), 6: ("bsd,mit", 1.0),
    }
    r = random.Random(3)
    words = TEMPLATES["bsd"].split()
    texts = []
    for _ in range(120):
        ws = [w for w in words if r.random() > 0.04]
        for _ in range(r.randint(0, 9)):
            ws.insert(r.randrange(len(ws) + 1), "x")
        texts.append("".join(w + r.choice("  \n") for w in ws))
    want = []
    for text in texts:
        ws, span = text.split(), -(-len(words) * 5 // 4)
        blocks = [set(ws[i : i + span]) for i in range(len(ws))] + [set(x.split()) for x in text.split("\n")]
        best = max(len(b & set(words)) for b in blocks) / len(set(words))
        want.append(best if best >= 0.9 else 0.0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in license_scan(df, phrases={}, templates={"bsd": TEMPLATES["bsd"]}).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want) and 0 < sum(x > 0 for x in want) < len(want)


def test_html_in_other_languages():
    bodies = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa"
        " dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura, tanto amara che poco più morte.",
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме Облонских."
        " Жена узнала, что муж был в связи с бывшею в их доме француженкою-гувернанткой, и объявила мужу, что не может жить с ним.",
        "話說天下大勢分久必合合久必分周末七國分爭并入於秦及秦滅之後楚漢分爭又并入於漢漢朝自高祖斬白蛇而起義一統天下後來光武中興傳至獻帝"
        "遂分為三國推其致亂之由殆始於桓靈二帝桓帝禁錮善類崇信宦官及桓帝崩靈帝即位大將軍竇武太傅陳蕃共相輔佐",
        "Litwo, ojczyzno moja, ty jesteś jak zdrowie, ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej"
        " ozdobie widzę i opisuję, bo tęsknię po tobie, panno święta, co jasnej bronisz Częstochowy i w Ostrej świecisz Bramie.",
    ]
    links = "<div>" + "".join(f"<a href={i}>Link {i} xxxxxxxxxxxxxxxxxx</a> " for i in range(8)) + "</div>"
    english = "It was the end of the day and the man had to be at the house that was on the hill, so he went with her there. " * 3
    for body in bodies:
        assert html_text.main_text(f"{links}<div><p>{body}</p><p>{body}</p></div>{links}") == f"{body} {body}"
        # in an article, a block of links doesn't take the rest with it
        assert html_text.main_text(f"<article>{links}<p>{body}</p></article>") == body
    # a paragraph of another script in an English page; a list of keywords stays out of it
    page = f"{links}<p>{english}</p><p>{bodies[1]}</p>{links}<p>{'keyword list without function words ' * 6}</p>{links}"
    assert html_text.main_text(page) == f"{english.strip()} {bodies[1]}"


def test_html_hints_in_names_of_content():
    long = "It was the end of the day and the man had to be at the house that was on the hill, so he went with her there. " * 3
    long = long.strip()
    p = f"<p>{long}</p>"
    for page, want in [
        (f"<article>{p}<section id='related-work'><h2>Related work</h2>{p}<p>See Smith.</p></section>{p}</article>", f"{long} Related work {long} See Smith. {long}"),
        (f"<article>{p}<h2 id='search'>Search</h2>{p}</article>", f"{long} Search {long}"),
        (f"<article><div class='post-header'><h1>Title</h1><span>By A</span></div>{p}</article>", f"Title {long}"),
        (f"<article id='login-guide'><h1>Login</h1>{p}</article>", f"Login {long}"),
        (f"<main><section id='navigation'>{p}</section></main>", long),
        (f"<main><div id='cookie-policy'>{p}<p>{long[:111]}</p></div></main>", f"{long} {long[:111]}"),
        (f"<article><p>The <span class='search-term'>word</span> of the day. {long}</p></article>", f"The word of the day. {long}"),
        (f"<div><div id='history-of-search'>{p}</div></div>", long),
        # furniture stays out, long or not
        (f"<article>{p}<div class='comment-list'>{p}</div><div id='comments'>{p}</div><div class='related-posts'>{p}</div></article>", long),
        (f"<article>{p}<div class='share-this'>Share this</div><div id='share-this'>Share</div>{p}</article>", f"{long} {long}"),
        (f"<div><div class='user-comment-thread'>{p}</div><div class='site-footer'>{p}</div>{p}</div>", long),
        (f"<div id='comments'><article class='comment-body'>{p}</article></div><article>{p}</article>", long),
    ]:
        assert html_text.main_text(page) == want, page


def test_vectors_in_a_hot_group_have_all_links(spark):
    g = np.random.default_rng(11)
    base = g.standard_normal((1500, 64))
    far = g.uniform(0.15, 0.45, (2000, 1)) * np.linalg.norm(base[0]) / 8
    x = np.concatenate([base, base[0] + far * g.standard_normal((2000, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(df, leaf=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert want.max() > 1500 and [got[i] for i in range(len(x))] == want.tolist()


def test_quality_learns_one_row_an_id_within_its_bytes(spark, monkeypatch):
    rows = [(1, "word " * 30, 1)] * 400 + [(1, "other text", 1)] + [(i, f"Some text {i}." if i % 2 else f"%%% {i}", 1) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").union(spark.createDataFrame([(None, "x", 1)], "doc_id long, text string, y int"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(4, 1), (None, 0)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)) or fit(x, y))
    quality.train(docs, labels)
    quality.train(docs, labels, per_class=3)
    quality.train(docs, labels, class_bytes=600)
    allowed = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(seen[0][0]) == len(allowed) + (4 in allowed)
    assert Counter(seen[1][1].tolist()) == {0: 3, 1: 3}
    for y in (0, 1):
        sizes = [x.nbytes for x, label in zip(*seen[2], strict=True) if label == y]
        assert sizes and (sum(sizes) <= 600 or len(sizes) == 1)


def test_mixing_spreads_what_it_does_not_take(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, "a")] * 300 + [(i, "w " * (i % 9), "a" if i % 20 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all of so few rows are one partition
    try:
        got = mixing.mix(df).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = Counter(x.p for x in got)
    assert len(parts) > 1 and max(parts.values()) < 0.6 * len(got)
    taken = [x.position for x in got if x.position is not None]
    assert taken == sorted(taken) and all(x.position is None for x in got[len(taken):])


def test_without_a_shared_folder_a_cluster_is_told(spark, monkeypatch):
    from loomline.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://a:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.work_dir(Session())
