"""Results against brute force, exact round trips and held-out labels on the small tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import components, decontam, jaccard, langid, license, media, packing, quality, sharding, tokencount, urlrules
from plumbline.llm.queries import ORACLE_SQL, QUERIES
from plumbline.llm.textvec import Words, text_buffer
from plumbline.llm.wordbpe import WordBpe

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def test_words_are_those_of_the_definition(rows):
    texts = [r.text for r in rows[:50]] + ["", "A-b É ßx 1", None]
    w = Words(*text_buffer(pa.array(texts, pa.string())))
    assert np.diff(w.first).tolist() == [len(WORD.findall(lower(t or ""))) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ '’1é×ÇİÿŸ \n<|>.²", max_size=40), max_size=6))
def test_bpe_equals_the_library(texts):
    bpe = WordBpe.load()
    ids, first = bpe.encode(*text_buffer(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == bpe.tok.encode(t, add_special_tokens=False).ids


def test_quality_agrees_with_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op1_quality_classifier"](spark, sf).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality], [r for r in got if not r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.98 and sum(not r.kept for r in bad) / len(bad) > 0.9


def plain_statistics(text):
    """What the labellers look at, byte by byte."""
    b = text.encode()
    space = {32, 10, 9, 13}
    letter = lambda x: 65 <= x <= 90 or 97 <= x <= 122 or x >= 128
    head = lambda x: x < 128 or x >= 192
    words = re.split(rb"[ \n\t\r]+", b.strip(b" \n\t\r")) if b.strip(b" \n\t\r") else []
    odd = [sum(not letter(x) for x in w) for w in words]
    n, chars = max(len(words), 1), max(sum(map(head, b)), 1)
    found = WORD.findall(lower(text))
    share = lambda x: len(set(x)) / len(x) if x else 1.0
    blocks = [found[i : i + quality.BLOCK] for i in range(0, len(found), quality.BLOCK)]
    lines = re.findall(rb"[^\n]*\n|[^\n]+$", b)
    return {
        "plain": sum(o == 0 or (o == 1 and w[-1:] in (b",", b".")) for o, w in zip(odd, words, strict=True)) / n, "marks": sum(not letter(x) and x not in space and not 48 <= x <= 57 for x in b) / chars,
        "upper": sum(65 <= x <= 90 for x in b) / max(sum(letter(x) and head(x) for x in b), 1), "symbols": sum(chr(x) in "#$%&*+=<>@^_`{}~[]\\/" for x in b) / chars, "word_length": sum(x not in space and head(x) for x in b) / n,
        "distinct_words": sum(len(set(x)) for x in blocks) / len(found) if found else 1.0, "distinct_grams": share(list(zip(*[found[i:] for i in range(5)], strict=False))), "distinct_lines": share(lines), "chars": sum(map(head, b)),
    }


def test_quality_votes_and_posterior_against_brute_force(spark, sf, rows):
    """The query's posterior from statistics taken byte by byte and EM over single documents instead of counted patterns."""
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    every = [plain_statistics(r.text or "") for r in rows]
    columns = {k: np.array([s[k] for s in every], float) for k in every[0]}
    data = text_buffer(pa.array([r.text for r in rows], pa.string()))
    fast = quality.statistics(*data)
    for k in columns:
        assert np.allclose(columns[k], fast[k]), k
    votes = quality.votes(columns)
    bad = quality.fit_votes(votes, np.ones(len(votes)))
    assert np.allclose([got[r.doc_id].posterior for r in rows], 1 - bad, atol=1e-5)
    assert [got[r.doc_id].n_votes for r in rows] == (votes < 2).sum(1).tolist() and all(r.kept == (r.score >= quality.KEEP) for r in got.values())
    agree = [(got[r.doc_id].score >= 0.5) == (b < 0.5) for r, b in zip(rows, bad, strict=True) if abs(b - 0.5) > 0.3]
    assert sum(agree) / len(agree) > 0.97  # the scorer learns what the posteriors say


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9])
    v = np.where(rng.random((4000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random(v.shape) < 0.2] = 2
    patterns, back, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    assert ((quality.fit_votes(patterns, n.astype(float))[back.ravel()] > 0.5) == truth).mean() > 0.96


def test_license_against_brute_force(spark, sf, rows):
    got = {r.doc_id: r for r in QUERIES["op2_license_scan"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = WORD.findall(lower(r.text))
        places = [(i, label) for p, label in license.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        g = got[r.doc_id]
        want = (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == want and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_license_templates_allow_edits(spark):
    text = "Redistribution and use in source and binary forms, with OR without changes are permitted"
    got = license.scan(spark.createDataFrame([(1, text), (2, "source and binary forms only")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].labels == "bsd" and 0.8 <= got[0].score < 1 and got[1].labels == ""
    apart = "source and binary forms. Redistribution and use in source or binary form, with or without modification are permitted"
    (one,) = license.scan(spark.createDataFrame([(1, apart)], "doc_id long, text string")).collect()
    assert (one.labels, one.score) == ("", 0.0)  # enough words agree, but the key phrase stands elsewhere


def test_mined_rules_have_their_confidence(spark):
    rows = [(["a", "b"], "block")] * 9 + [(["a", "c"], "allow")] * 6 + [(["b"], "block")] * 5
    mined, items = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert {(tuple(r.tokens), r.verdict): r.confidence for r in mined.collect()} == {(("b",), "block"): 1.0, (("c",), "allow"): 1.0}
    urls = spark.createDataFrame([("u1", ["a", "b"]), ("u2", ["c", "x"]), ("u3", ["a"])], "url string, tokens array<string>")
    assert {r.url: r.mined for r in urlrules.apply_rules(urls, mined, items).collect()} == {"u1": "block", "u2": "allow"}


def brute_rules(rows, min_support=0.01, min_confidence=0.8):
    """Every set of at most MAX_TOKENS items (at most one a host suffix) with its verdict's support and confidence, no part of it as good."""
    n = len(rows)
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    classes = {}
    for t, own in where.items():
        if len(own) >= min_support * n:
            classes.setdefault(frozenset(own), []).append(t)
    items = {}
    for own, tokens in classes.items():
        host = max((t for t in tokens if t.startswith("h:")), key=len, default=None)
        items[host or max(tokens, key=lambda t: (len(t), t))] = own
    out = {}
    for k in range(1, urlrules.MAX_TOKENS + 1):
        for names in itertools.combinations(sorted(items), k):
            if sum(x.startswith("h:") for x in names) > 1:
                continue
            both = frozenset.intersection(*(items[x] for x in names))
            for verdict in ("allow", "block"):
                got = sum(rows[i][1] == verdict for i in both)
                if both and got >= min_support * n and got >= min_confidence * len(both):
                    out[names, verdict] = got / len(both)
    return {(names, v): c for (names, v), c in out.items() if not any(out.get((part, v), 0) >= c for k in range(1, len(names)) for part in itertools.combinations(names, k))}


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        host = rng.choice(["a.x.com", "b.x.com", "y.com", "z.org"], p=(0.4, 0.2, 0.2, 0.2))
        labels = str(host).split(".")
        suffixes = ["h:" + ".".join(labels[k:]) for k in range(len(labels))]
        rest = [f"p{i}:{rng.choice(['u', 'v'])}" for i in range(3)] + ([] if rng.random() < 0.5 else ["q:id", "q:page"])
        rows.append(([*suffixes, *rest], "block" if ("p0:u" in rest and host != "z.org") ^ (rng.random() < 0.1) else "allow"))
    mined, _ = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in mined.collect()}
    want = brute_rules(rows)
    assert got == pytest.approx(want) and len(want) > 3


def test_long_hosts_and_paths_do_not_multiply(spark):
    """A host of 24 labels, each a frequent suffix of its own, and a path of 20 fixed segments."""
    labels = [f"l{k}" for k in range(24)]
    rows = []
    for k in range(480):
        own = labels[: 24 - k % 24]
        suffixes = ["h:" + ".".join(reversed(own[:j])) for j in range(1, len(own) + 1)]
        rows.append(([*suffixes, *(f"p{i}:s" for i in range(20))], "block" if len(own) > 12 else "allow"))
    mined, items = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    url = spark.createDataFrame([("u", ["h:l0", "h:l1.l0", "h:" + ".".join(reversed(labels))])], "url string, tokens array<string>")
    assert mined.count() > 5 and urlrules.apply_rules(url, mined, items).first().mined == "block"


def test_a_confidence_tie_is_blocked(spark):
    rows = [(["a", "b", "c"], "block"), (["d", "e"], "allow")] * 20 + [(["a"], "block"), (["d"], "allow")] * 5
    mined, items = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    urls = spark.createDataFrame([("u", ["a", "d"]), ("v", ["d", "b"]), ("w", ["e"])], "url string, tokens array<string>")
    assert {r.url: r.mined for r in urlrules.apply_rules(urls, mined, items).collect()} == {"u": "block", "v": "block", "w": "allow"}


def test_language_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = [r for r in QUERIES["op4_language_id"](spark, sf).join(docs, "doc_id").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and sum(r.accepted for r in got) / len(got) > 0.99


def test_kneser_ney_against_brute_force():
    """The sorted arrays give what nested counting gives, and each context's probabilities sum to one."""
    text = "the cat sat on the mat and the dog ran über"
    sym, _ = langid.symbols([text])
    code, n = np.unique(langid.codes(sym)[0], return_counts=True)
    model = langid.KneserNey(code, n)
    every = np.arange(1 << langid.BITS, dtype=np.uint64)
    for context in (0, (ord("t") << 16) | ord("h"), ord("e")):
        total = np.exp(model.log_probability((np.uint64(context) << np.uint64(16)) + every)).sum()
        assert abs(total - 1) < 1e-5
    words = [int(x) for x in sym]
    grams = []
    for i in range(len(words)):
        own = [words[i]]
        for k in (1, 2, 3):
            own.append(words[i - k] if i >= k and (k == 1 or own[-1] != 0) else 0)
        if own[0] or own[1]:
            grams.append(tuple(own))
    tables = [Counter(grams)]
    for k in (3, 2, 1):
        tables.insert(0, Counter(g[:k] for g in tables[0]))

    def probability(g, k):
        if k == 0:
            return 1 / (1 << 16)
        t = tables[k - 1]
        once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = {x: v for x, v in t.items() if x[1:] == g[1:k]}
        if not same:
            return probability(g, k - 1)
        total = sum(same.values())
        return max(same.get(g[:k], 0) - d, 0) / total + d * len(same) / total * probability(g, k - 1)

    for g in [*grams[:20], (ord("z"), ord("h"), ord("t"), 0), (ord("é"), ord("a"), 0, 0)]:
        one = np.array([sum(x << (16 * i) for i, x in enumerate(g))], np.uint64)
        assert np.exp(model.log_probability(one)[0]) == pytest.approx(probability(g, 4), rel=1e-4)


def test_scripts_do_not_mix(spark):
    """Languages in one script beyond ASCII, learnt from different words; what none of them writes is rejected."""
    rng = np.random.default_rng(2)
    words = {"aa": "привет мир дом река сад вечер окно".split(), "bb": "кошка рыба стол лампа книга ветер".split(), "cc": "日本 東京 大学 学校 山川".split(), "dd": "中国 北京 文学 天地 人民".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(list(words) * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, _, accepted = model.predict([" ".join(rng.choice(w, 20)) for w in words.values()] + ["แม่น้ำ ภูเขา ทะเล " * 8, "the quiet house by the river " * 8])
    assert names[:4] == list(words) and accepted.tolist() == [True] * 4 + [False] * 2


def test_models_are_bounded(spark, docs):
    whole, part = langid.train(docs), langid.train(docs, 8000)
    sizes = lambda m: sum(len(x.grams[-1][0]) for x in m.models)
    assert sizes(part) <= 8000 < sizes(whole)
    assert part.predict(["the and of to in is that was for it with on the"])[0] == ["en"]


def test_models_keep_all_codes_whatever_their_number(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "_bounded", lambda counts, most: pytest.fail("codes were left out"))
    rows = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~langid.is_held_out())
    model = langid.train(rows)
    assert model.languages == sorted(r.lang for r in rows.select("lang").distinct().collect())


def test_rejection_is_calibrated_on_all_rows_set_aside(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.Model, "calibrate", lambda self, lang, n, cost: seen.append(len(lang)))
    text = "the and of to in is that was for it with on the"
    rows = spark.range(120_000).selectExpr("id doc_id", f"'{text}' text", "'en' lang")
    langid.train(rows)
    crc = [zlib.crc32(str(k).encode()) for k in range(120_000)]
    assert seen == [sum(c % 3 != 1 and c // 3 % langid.SET_ASIDE == 0 for c in crc)]


def test_strange_text_is_rejected(spark, docs):
    model = langid.train(docs)
    names, _, accepted = model.predict(["zzzq xqzj kkkqq vvvxz jqxzk wwwqk zzxqj qqqzv " * 20, "the and of to in is that was for it with on the"])
    assert not accepted[0] and accepted[1] and names[1] == "en"


def test_packing_against_the_library(spark, sf, rows):
    bpe = WordBpe.load()
    got = QUERIES["op5_best_fit_packing"](spark, sf).collect()
    by_doc, bins = {}, {}
    for g in got:
        by_doc.setdefault(g.doc_id, []).append(g)
        bins.setdefault(g.sequence_id, []).append(g)
    total = 0
    for r in rows:
        ids = np.array([*bpe.tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[r.doc_id], key=lambda g: g.piece)
        assert [g.piece for g in pieces] == list(range(-(-len(ids) // 4096)))
        for g in pieces:
            part = ids[4096 * g.piece : 4096 * (g.piece + 1)]
            assert (g.start, g.length, g.ids_crc32) == (4096 * g.piece, len(part), zlib.crc32(part.tobytes()))
    for parts in bins.values():
        at = 0
        for g in sorted(parts, key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) * 1.002 + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(lengths):
    bins, offsets, fill = packing.best_fit(np.array(lengths, np.int64), 64)
    assert sum(fill) == sum(lengths) and all(f <= 64 for f in fill)
    for b in range(len(fill)):
        own = sorted((o, n) for x, o, n in zip(bins, offsets, lengths, strict=True) if x == b)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()


def test_packing_merges_partitions(spark, docs, monkeypatch):
    few = packing.pack(docs.repartition(1)).select("sequence_id").distinct().count()
    many = packing.pack(docs.repartition(40)).select("sequence_id").distinct().count()
    assert many <= few + 1


def test_sharding_is_a_law(spark, sf, rows):
    got = QUERIES["op6_sharding"](spark, sf).collect()
    n = Counter(g.shard for g in got)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    assert sorted((g.doc_id, g.size, g.text_crc32) for g in got) == sorted((r.doc_id, len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in rows)
    for s in n:
        assert sorted(g.slot for g in got if g.shard == s) == list(range(n[s]))
    assert sorted(g.row for g in got) == list(range(len(rows)))
    assert {(g.doc_id, g.shard, g.slot) for g in got} == {(g.doc_id, g.shard, g.slot) for g in QUERIES["op6_sharding"](spark, sf).collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 997, 4096])
def test_permutation(spark, n):
    out = spark.range(n).select(sharding.permute(sharding.F.col("id"), n).alias("p")).collect()
    assert sorted(r.p for r in out) == list(range(n))
    assert n < 100 or [r.p for r in out] != list(range(n))


def test_shards_are_written(spark, docs, tmp_path):
    a = sharding.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("doc_id", "shard", "slot").exceptAll(a.select("doc_id", "shard", "slot")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab \né", max_size=300), st.lists(st.tuples(st.integers(-3, 320), st.integers(0, 90), st.text(alphabet="cd \né'", max_size=30)), max_size=5))
def test_edit_counts(text, edits):
    bpe = WordBpe.load()
    cut = tokencount.cut_leaves
    tokencount.cut_leaves = lambda t, size=24: cut(t, size)
    try:
        (tree,) = tokencount.build([text.encode()], bpe)
        tokencount.apply_edits([tree], [[{"pos": p, "n_delete": n, "insert": x} for p, n, x in edits]], bpe)
    finally:
        tokencount.cut_leaves = cut
    for p, n, x in edits:
        p = min(max(p, 0), len(text))
        text = text[:p] + x + text[p + n :]
    assert b"".join(tree.leaves).decode() == text and tree.total == len(bpe.tok.encode(text, add_special_tokens=False).ids)


def test_counts_of_all_documents(spark, sf, rows):
    bpe = WordBpe.load()
    got = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, sf).collect()}
    for r in rows:
        n = len(r.text)
        t = "Second edition. " + r.text
        t = t[: n // 2] + t[n // 2 + 40 :]
        t = t[: n // 3] + " see the note below " + t[n // 3 :] + "\nEnd of text."
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_edited) == tuple(len(bpe.tok.encode(x, add_special_tokens=False).ids) for x in (r.text, t))


def test_media_round_trip(spark, sf, rows):
    got = {r.doc_id: r for r in QUERIES["op8_media_columns"](spark, sf).collect()}
    for r in rows:
        raw = r.text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert g.media_sha256 == hashlib.sha256(media.encode_many([payload])[0]).hexdigest()


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, code):
        self.s += code

    def bytes(self):
        raw = int(self.s.ljust(-(-len(self.s) // 8) * 8, "1"), 2).to_bytes(-(-len(self.s) // 8), "big") if self.s else b""
        return raw.replace(b"\xff", b"\xff\0")


def codes(by_length):
    out, code = {}, 0
    for n in range(1, 17):
        for s in by_length.get(n, []):
            out[s] = format(code, f"0{n}b")
            code += 1
        code <<= 1
    return out


@pytest.mark.parametrize("interval", [0, 2])
def test_decoder_on_an_ordinary_jpeg(interval):
    """Two components (luminance 2 x 1), runs, ZRL, end of block and DC differences, written bit by bit."""
    rng = np.random.default_rng(5)
    dc_table, ac_table = {4: list(range(8)), 5: [8, 9, 10, 11]}, {2: [0x00], 4: [0x01, 0x02, 0x03, 0x11], 8: [0xF0, *range(0x12, 0x18), *range(0x21, 0x27), *range(0x04, 0x0A), 0x31, 0x41, 0x51]}
    dc, ac = codes(dc_table), codes(ac_table)
    size = lambda v: int(abs(v)).bit_length()
    value = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b")
    mcus, layout = 6, [0, 0, 1]
    blocks = []
    for _ in range(mcus * len(layout)):
        c = np.zeros(64, int)
        c[0] = rng.integers(-300, 300)
        for k in rng.choice(np.arange(1, 60), 4, replace=False):
            c[k] = rng.integers(-3, 4)
        c[40:60] = 0
        c[39] = rng.integers(-3, 4)
        blocks.append(c)
    segments, bits, last = [], Bits(), [0, 0]
    for m in range(mcus):
        if interval and m and m % interval == 0:
            segments.append(bits.bytes())
            bits, last = Bits(), [0, 0]
        for j, part in enumerate(layout):
            c = blocks[m * len(layout) + j]
            d = int(c[0]) - last[part]
            last[part] = int(c[0])
            bits.put(dc[size(d)] + value(d))
            run = 0
            top = max([k for k in range(1, 64) if c[k]], default=0)
            for k in range(1, top + 1):
                if not c[k]:
                    run += 1
                    continue
                while run > 15:
                    bits.put(ac[0xF0])
                    run -= 16
                sym = run << 4 | size(c[k])
                if sym not in ac:  # not in the table: drop the value
                    c[k] = 0
                    run += 1
                    continue
                bits.put(ac[sym] + value(int(c[k])))
                run = 0
            bits.put(ac[0])
    segments.append(bits.bytes())
    scan = b"".join(s + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(segments) else b"") for i, s in enumerate(segments))
    seg = media._segment
    sof = seg(0xC0, bytes([8, 0, 24, 0, 32, 2, 1, 0x21, 0, 2, 0x11, 0]))
    image = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([2] * 64)) + sof + seg(0xC4, media._huffman_body(0, dc_table)) + seg(0xC4, media._huffman_body(1, ac_table)) + (seg(0xDD, bytes([0, interval])) if interval else b"") + seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (head, coefs), _ = media.decode_many([image, image])
    assert (head.width, head.height, head.mcus) == (32, 24, (2, 3)) and (coefs == np.array(blocks)).all()
    thumb = media.thumbnail(head, coefs)
    assert thumb.shape == (3, 4) and thumb[0, 0] == np.clip((2 * blocks[0][0] + 4) // 8 + 128, 0, 255) and thumb[1, 3] == np.clip((2 * blocks[3 * 3 + 1][0] + 4) // 8 + 128, 0, 255)


def shingle_sets(rows):
    out = {}
    for r in rows:
        w = WORD.findall(lower(r.text or ""))
        if w:
            out[r.doc_id] = frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)])
    return out


def classes_of(sets):
    links, group = Counter(), {k: k for k in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {k: (find(k), links[k]) for k in sets}


def test_jaccard_against_brute_force(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = classes_of(shingle_sets(rows))
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op10_jaccard_join"](spark, sf).collect()}
    assert got == want and sum(n for _, n in want.values()) > 100


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(jaccard, "BUCKET_BLOCKS", 3)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(80, int(rng.integers(0, 3)), replace=False):
            w[k] = f"x{rng.integers(1000)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = classes_of(shingle_sets(df.collect()))
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 150: 100, 200: 100}


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_decontamination_against_brute_force(spark, sf, rows):
    """All items against all documents: the same pairs and scores as full alignment. A pair that shares fewer words than the score
    needs cannot reach it, so those are not aligned here."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op9_decontamination"](spark, sf).collect()}
    words, want = {r.doc_id: WORD.findall(lower(r.text)) for r in rows}, {}
    bags = {d: Counter(w) for d, w in words.items()}
    for item in items:
        w = WORD.findall(lower(item.text))
        bag = Counter(w)
        for d in words:
            if 2 * sum(min(n, bags[d][x]) for x, n in bag.items()) >= len(w) and (s := smith_waterman(w, words[d])) >= 0.5:
                want[d, item.item_id] = s
    assert got == pytest.approx(want) and len(want) >= 3


def test_the_seeds_miss_no_edited_copy(spark):
    """One run of three words is all that is left whole; and items of one and two words."""
    docs = [(1, "prefix aa bb cc zz ee ff yy hh ii xx jj suffix"), (2, "alone"), (3, "two words here"), (4, "words two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj"), (2, "Alone"), (3, "two words"), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 1): smith_waterman(*(t.split() for t in ("aa bb cc dd ee ff gg hh ii jj", docs[0][1]))), (2, 2): 1.0, (3, 3): 1.0} and got[1, 1] >= 0.5
    assert sorted(r.doc_id for r in decontam.keep_clean(df, bench).collect()) == [2, 3, 4]


def test_edited_copies_are_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    w = item.split()
    edited = " ".join(x if i % 6 != 5 else "changed" for i, x in enumerate(w))
    dropped = " ".join(x for i, x in enumerate(w) if i % 7 != 6)
    docs = spark.createDataFrame([(1, f"some text before {edited} and after"), (2, dropped), (3, "alpha beta gamma only"), (4, " ".join(reversed(w)))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in decontam.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(smith_waterman(w, f"some text before {edited} and after".split()))


def test_benchmark_blocks(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert sum(1 for _ in decontam.indexes(docs, bench, 4000)) > 1
    kept = decontam.keep_clean(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in whole}


def test_evenly_edited_copies_are_found(spark):
    """Every 4th and 5th word replaced, in a lone copy and beside whole ones; every 3rd; a word put after each."""
    rng = np.random.default_rng(3)
    items = [[f"i{k}w{j}" for j in rng.permutation(40)] for k in range(10)]
    docs, want = [], set()
    for k, w in enumerate(items):
        step = (4, 5, 4, 5, 3)[k % 5]
        edited = [x if i % step != step - 1 else f"new{k}x{i}" for i, x in enumerate(w)] if k != 9 else [y for i, x in enumerate(w) for y in (x, f"new{i}")]
        docs += [(k, " ".join(["before", *edited, "after"]))] + [(100 + 10 * k + j, " ".join(w)) for j in range(3 if k in (2, 3) else 0)]
        want |= {(d, k) for d, _ in docs if d == k or (d - 100) // 10 == k}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == want and decontam.keep_clean(df, bench).count() == 0
    assert all(got[k, k].score == pytest.approx(smith_waterman(items[k], docs_words)) for k, docs_words in ((d, t.split()) for d, t in docs if d < 10))
    assert (got[0, 0].first_word, got[0, 0].end_word) == (1, 40)


def test_decontamination_of_common_words_against_brute_force():
    """Texts over few words, where every word is common: the same pairs and scores as the full matrix."""
    rng = np.random.default_rng(8)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 30, n)]
    items, docs = [text(int(rng.integers(5, 25))) for _ in range(12)], []
    for k in range(60):
        copy = [y for x in items[k % 12] for y in ((x,), text(1), (x, *text(1)), ())[rng.choice(4, p=(0.5, 0.2, 0.2, 0.1))]]
        docs.append([*text(int(rng.integers(0, 20))), *copy, *text(int(rng.integers(0, 20)))])
    index = decontam.Index(list(range(12)), [" ".join(w) for w in items])
    words = decontam.Words(*decontam.text_buffer(pa.array([" ".join(w) for w in docs])))
    index.choose(np.bincount(index.codes(words)[index.codes(words) >= 0], minlength=len(index.vocabulary)))
    doc, item, score, *_ = index.find(*decontam.text_buffer(pa.array([" ".join(w) for w in docs])))
    got = {(d, i): s for d, i, s in zip(doc.tolist(), item.tolist(), score.tolist(), strict=True)}
    full = {(d, i): smith_waterman(a, b) for d, b in enumerate(docs) if b for i, a in enumerate(items)}
    want = {k: s for k, s in full.items() if s >= 0.5}
    assert got == pytest.approx(want) and 20 < len(want) < len(full)


def test_common_copies_of_short_items_are_found(spark):
    """Items of 3, 4 and 5 words, each whole in 10 documents; two words in a row are no find."""
    items = [[f"s{n}x{j}" for j in range(n)] for n in (3, 4, 5)]
    docs = [(10 * k + d, " ".join([f"a{d}", *w, f"b{d}"])) for k, w in enumerate(items) for d in range(10)] + [(100 + k, " ".join(["a", *w[:2], "b"])) for k, w in enumerate(items)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench).collect()}
    assert got == {(10 * k + d, k): 1.0 for k in range(3) for d in range(10)}
    assert sorted(r.doc_id for r in decontam.keep_clean(df, bench).collect()) == [100, 101, 102]


def test_excerpts_of_long_items_are_found(spark):
    """50 and 150 successive words of an item of 400, and all of it with every 4th word replaced."""
    w = [f"long{j}" for j in range(400)]
    docs = [(1, ["a", *w[73:123], "b"]), (2, ["a", *w[120:270], "b"]), (3, [x if i % 4 else "new" for i, x in enumerate(w)]), (4, w), (5, w[30:50])]
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == got[4] == 1.0 and [r.doc_id for r in decontam.keep_clean(df, bench).collect()] == [5]


def test_parts_of_long_items():
    for n in (0, 3, 99, 100, 149, 150, 1001):
        item, start, size = decontam.parts(np.array([0, n]))
        held = [range(s, s + k) for s, k in zip(start.tolist(), size.tolist(), strict=True)]
        assert held[0].start == 0 and held[-1].stop == n and (n < 100 or all(50 <= k < 100 for k in size))
        for a in range(n - 49):  # 50 successive words give some part half of its words
            assert any(2 * (min(a + 50, r.stop) - max(a, r.start)) >= len(r) for r in held)


def test_one_row_of_each_class_is_kept(spark):
    """Null and repeated ids: copies and near copies in classes with another representative do not come back."""
    one, two, three = ([f"{c}{i}" for i in range(60)] for c in "xyz")
    near = lambda w: " ".join([*w[:-1], "end"])
    docs = [(None, " ".join(one)), (None, near(one)), (None, " ".join(one)), (None, near(two)), (3, " ".join(two)), (5, " ".join(three)), (5, " ".join([*one, "more"])), (5, near(three)), (None, ""), (None, ""), (6, None)]
    kept = jaccard.keep_one(spark.createDataFrame([(*r, k) for k, r in enumerate(docs)], "doc_id long, text string, n long")).collect()
    assert sorted(("" if not r.text else r.text[0], r.doc_id is None) for r in kept) == [("", False), ("", True), ("x", False), ("y", False), ("z", False)]
    assert all((r.doc_id, r.text) == docs[r.n] for r in kept)


def test_merge_rounds_go_on_while_a_piece_fits(spark):
    """Pieces of alike lengths over many partitions: as few bins as from one; pieces of which no two fit stay alone."""
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('word ', cast(20 + id % 7 as int)) text")
    few = packing.pack(docs.repartition(1)).select("sequence_id").distinct().count()
    assert packing.pack(docs.repartition(40)).select("sequence_id").distinct().count() <= few + 1
    alone = spark.range(60).selectExpr("id doc_id", "repeat('word ', 40) text").repartition(20)
    assert packing.pack(alone, capacity=64).select("sequence_id").distinct().count() == 60


def test_a_row_of_very_many_copies_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    monkeypatch.setattr("plumbline.llm.shared.COPIES_AT_ONCE", 16)
    docs = spark.range(300).selectExpr("if(id < 200, 1, id) doc_id", "if(id < 200, 'same', cast(id as string)) text")
    got = sharding.assign(docs, 7).collect()
    assert sorted(g.row for g in got) == list(range(300)) and sum(g.doc_id == 1 for g in got) == 200
    for s in range(7):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(len([g for g in got if g.shard == s])))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cur.fetchall())


def test_edits_touch_only_their_slots():
    """An insertion of many leaves in a long text changes one slot and the sums above it; nothing else is built again."""
    bpe = WordBpe.load()
    (tree,) = tokencount.build([("word " * 20000).encode()], bpe)
    slots = [id(x) for x in tree.slots]
    spent = tokencount.apply_edits([tree], [[{"pos": 50000, "n_delete": 0, "insert": " new" * 2000}, {"pos": 50004, "n_delete": 7000, "insert": ""}]], bpe)
    text = "word " * 20000
    text = text[:50000] + " new" * 2000 + text[50000:]
    text = text[:50004] + text[57004:]
    assert b"".join(tree.leaves).decode() == text and tree.total == len(bpe.tok.encode(text, add_special_tokens=False).ids)
    assert sum(a != id(b) for a, b in zip(slots, tree.slots, strict=True)) <= 1 and spent[0] < 20000


def test_ties(spark):
    """Equal texts, equal scores, equal lengths: the same result whatever the order and partitions of the rows."""
    rows = [(i, t) for i, t in enumerate(["one two three four five six seven", "one two three four five six seven", "a b c", "", None, "x " * 400] * 3)]
    schema = "doc_id long, text string"
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (3, "three four five six seven")], "item_id long, text string")
    seen = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema).repartition(5)
        found = sorted(tuple(r) for r in decontam.contaminated(df, bench).collect())
        classes = sorted(tuple(r) for r in jaccard.near_duplicates(df).collect())
        lengths = sorted((r.doc_id, r.length) for r in packing.pack(df, capacity=64).collect())
        shards = sorted((r.doc_id, r.shard, r.slot) for r in sharding.assign(df, 5).collect())
        seen.append((found, classes, lengths, shards))
    assert seen[0] == seen[1]
    assert {(d, i) for d, i, *_ in seen[0][0]} == {(d, i) for d, t in rows if t and t.startswith("one") for i in (1, 2, 3)}


def test_a_very_long_url_is_judged(spark):
    long = "http://a.com/en/" + "x/" * 20000 + "?" + "&".join(f"q{i}=1" for i in range(3000))
    rows = spark.createDataFrame([(1, long), (2, "http://b.info/fr/" + "y" * 100000), (3, "http://a.com/en/1")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in urlrules.judge(rows).collect()}
    assert got[1] == got[3] == ("block", "com/en/") and got[2][1] is None
