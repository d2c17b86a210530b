"""Small tests of the parts that need no session."""

import html
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from learngraph.llm import bpe, embedding_duplicates, html_text, language_id, nearest, packing, quality, sentencepiece_codec, sharding, shingles, unicode_tables
from learngraph.llm.wavelet import WaveletMatrix

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a  b", "x \n y\n\nz ", " lead", "trail ", "tab\tb c", "é  x y", "<|endoftext|> hi<|endoftext|>", "'s it's 's don't", "a\n", "\na b", "b,,, c.. d!", "1 2,3 4", "a\0b c", "\0next\0 x", "漢字 かな 😀 ok", "a b \x1c c"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.BpeEncoder(BYTE_BPE, memo=200)


def same_ids(encoder, texts):
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_memoised_ids_are_the_librarys(encoder):
    same_ids(encoder, ODD)
    same_ids(encoder, [" ".join(f"word{i}x, Ab{'cd' * (i % 7)}. " for i in range(300)), None])
    assert encoder.encode([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \nabÉ.,'!1\t", max_size=25), max_size=4))
def test_memoised_ids_of_any_text(encoder, texts):
    same_ids(encoder, texts)


def brute_cost(at, penalty, size):
    cost = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        cost[j] = min(cost[i] + size - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= size and cost[i] is not None)
    return cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 3, 7])), min_size=1, max_size=30))
def test_cuts_have_the_least_cost(steps):
    at = [0, *itertools.accumulate(s for s, _ in steps)]
    penalty = [0, *(p for _, p in steps)]
    cuts = packing.best_cuts(at, penalty, 10, True)
    assert cuts[0] == 0 and cuts[-1] == at[-1]
    paid = sum(10 - (b - a) + penalty[at.index(b)] for a, b in zip(cuts, cuts[1:], strict=False))
    assert paid == brute_cost(at, penalty, 10)[-1]


def test_packer_keeps_every_token_once():
    rng = np.random.default_rng(0)
    packer = packing._Packer(5, 64, np.arange(100) % 10 == 0, 64 * 64)
    docs = [rng.integers(0, 100, n).astype(np.uint16) for n in [1, 1, 700, 3, 64, 128, 5000, 1, *rng.integers(1, 200, 100)]]
    pieces = []
    for i, d in enumerate(docs):
        packer.add(i, d)
        if packer.held >= packer.block:
            pieces += packer.pieces(False)
    pieces += packer.pieces(True)
    for i, d in enumerate(docs):
        own = [p for p in pieces if p[0] == i]
        assert [p[1] for p in own] == [0, *itertools.accumulate(p[2] for p in own)][:-1] and sum(p[2] for p in own) == len(d)
        assert all(p[3] == zlib.crc32(d[p[1] : p[1] + p[2]].astype("<u4").tobytes()) and p[4] == len(d) for p in own)
    for _, group in itertools.groupby(pieces, key=lambda p: p[5]):
        group = list(group)
        assert [p[6] for p in group] == [0, *itertools.accumulate(p[2] for p in group)][:-1] and sum(p[2] for p in group) <= 64


@pytest.mark.parametrize("n", [0, 1, 7, 8, 513, 3000])
def test_wavelet_matrix(n):
    x = np.random.default_rng(n).integers(0, 37, n).astype(np.uint16)
    starts = np.array([0, n // 2, n])
    blob = WaveletMatrix.build(x, 6).to_bytes(starts, np.array([5, 0]), np.array([True, False]))
    w, s, ids, known = WaveletMatrix.from_bytes(blob)
    assert (w.decode() == x).all() and s.tolist() == starts.tolist() and ids[0] == 5 and known.tolist() == [True, False]
    for i in range(0, n, 17):
        assert w.access(i) == x[i]
    for symbol in (0, 5, 36, 63, 64):
        at = np.flatnonzero(x == symbol)
        assert w.count(symbol) == len(at) and [w.select(symbol, k) for k in range(len(at) + 1)] == [*at.tolist(), -1]
        assert w.rank(symbol, n // 3) == (x[: n // 3] == symbol).sum()
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"x" + blob[1:])


def test_communication_matrix_fills_rows_and_columns():
    sizes, room = np.array([5, 0, 12, 1, 30]), np.array([7, 7, 6, 28])
    matrix = sharding.CommunicationMatrix(sizes, room, 1)
    rows = np.array([matrix.row(v) for v in range(5)])
    assert (rows.sum(1) == sizes).all() and (rows.sum(0) == room).all() and (rows >= 0).all()
    again = sharding.CommunicationMatrix(sizes, room, 1)
    assert all((again.row(v) == rows[v]).all() for v in (3, 0, 4, 1, 2))
    assert sorted(matrix.targets(4).tolist()) == np.repeat(np.arange(4), rows[4]).tolist()
    big = sharding.split_counts(np.random.default_rng(0), np.array([10**10, 10**10, 5]), 10**10)
    assert big.sum() == 10**10 and abs(big[0] - 5 * 10**9) < 10**6


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    owner = np.repeat([0, 2, 3], [6, 1, 5])
    scores = rng.normal(size=(12, 3))
    got = language_id.viterbi(scores, owner, 4, 0.8)
    for i in (0, 2, 3):
        own = scores[owner == i]
        value = lambda p: sum(own[t, s] for t, s in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(3), repeat=len(own))))
        assert abs(value(got[owner == i].tolist()) - best) < 1e-9


def test_language_spans_and_scripts():
    grams = np.zeros((language_id.BUCKETS, 2), np.float32) - 9
    samples = ["the and of that with this", "der und die das nicht ist"]
    for k, t in enumerate(samples):
        grams[np.unique(language_id._trigrams([t])[0]), k] = -1
    allowed = np.zeros((len(unicode_tables.SCRIPTS), 2), bool)
    allowed[unicode_tables.SCRIPTS.index("Latin")] = True
    model = language_id.Model(["en", "de"], grams, allowed)
    text = "the and of that 12 der und die das nicht ist"
    langs, score, spans = language_id.label(model, [text, None, "12 !?", "Это"], penalty=3.0)
    assert langs[:3] == ["de", "und", "und"] and score[1] == score[2] == 0 and 0 <= score.min() and score.max() <= 1
    first, end, which = spans[0]
    assert [text[a:b] for a, b in zip(first, end, strict=True)] == ["the and of that", "der und die das nicht ist"] and which.tolist() == [0, 1]
    assert language_id.label(language_id.Model([], np.zeros((language_id.BUCKETS, 0)), np.zeros((len(unicode_tables.SCRIPTS), 0), bool)), ["a"])[0] == ["und"]


def test_quality_separates_shouting_and_survives_empty_texts():
    good, bad = "a plain line of words, as one writes.\n" * 8, "LOUD!! WORDS!! ALL!! DAY!! " * 8
    texts = [good + str(i) for i in range(40)] + [good + bad + str(i) for i in range(40)]
    x, owner = quality.passages(texts)
    y = np.repeat([1.0, 0.0], 40).astype(np.float32)
    mean, scale = x.mean(0), x.std(0) + np.float32(0.05)
    model = quality.Model(0.5, quality.train((x - mean) / scale, owner, y), mean, scale)
    p, attention = quality.score_texts(model, [*texts, None, "", "   "])
    assert ((p[:80] >= 0.5) == (y == 1)).all() and np.isfinite(p).all() and all(abs(a.sum() - 1) < 1e-5 for a in attention)
    for i in (0, 45):
        alone, _ = quality.score_texts(model, [texts[i]])
        assert abs(alone[0] - p[i]) < 1e-5


def brute_shingles(text, n):
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


@pytest.mark.parametrize("n", [4, 5])
def test_shingle_sets(n):
    texts = [*ODD, "a b c d e", "A  b\tC d", "x y z w " * 9, "É é", "q " * 3]
    sets = shingles.shingle_sets(texts, n)
    assert [len(s) for s in sets] == [len(brute_shingles(t, n)) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(np.intersect1d(sets[a], sets[b])) == len(brute_shingles(texts[a], n) & brute_shingles(texts[b], n))
    assert (shingles.shingle_sets(["A b\vc\nD"], 4)[0] == shingles.shingle_sets(["a b c d"], 4)[0]).all()


def test_long_text_is_hashed_alike_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = shingles.shingle_sets([text], 5)[0]
    monkeypatch.setattr(shingles, "_CHUNK", 500)
    assert (shingles.shingle_sets([text], 5)[0] == whole).all()


def test_main_text():
    page = "<html><head><title>t</title><style>p{}</style></head><body><div id='cookie-banner'>Accept</div><nav><a href=x>Home</a></nav><article><h1>A &amp;amp; b</h1><p>One  <b>two</b>\n three<br>four<p>x<ul><li>l1<li>l2</ul><script>var s='</p>';</script><section class='comments'><p>reader</p></section></article><aside>side</aside><footer>&copy;</footer>"
    assert html_text.main_text(page) == "A &amp; b\nOne two three four\nx\nl1\nl2"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    body = "<div><h2>Head</h2><p>" + "word " * 60 + "</p><p>end</p></div><ul><li><a>l1</a><li><a>l2</a></ul>"
    assert html_text.main_text(body) == "Head\n" + ("word " * 60).strip() + "\nend"
    assert html_text.main_text("a < b &lt; c " + html.escape("<p>") * 3) == "a < b < c <p><p><p>"


def test_nearest_scan_is_exact_where_all_survive():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 32))
    x[200:] = x[0]
    ids, r = np.arange(300), np.linalg.qr(rng.normal(size=(32, 32)))[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 200, 10):
        want = np.lexsort((ids, -np.where(ids == i, -9, nearest.cosines(x, x[i]))))[:5]
        got = nearest.scan(x, ids, x[i], i, 5, u @ r, (u @ r)[i])
        hits += len({g for _, g in got} & set(want.tolist()))
    assert hits >= 95
    assert [g for _, g in nearest.scan(x, ids, x[0], 0, 5, u @ r, (u @ r)[0])] == [200, 201, 202, 203, 204]


def test_parameters_grow_slowly():
    assert embedding_duplicates.parameters(0) == embedding_duplicates.parameters(50_000) == (33, 12)
    assert embedding_duplicates.parameters(10**9)[1] == 26


def test_sentencepiece_parity():
    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"), threads=1)
    texts = [*ODD, "<s> hi</s> <unk>", "▁x ▁"]
    for t, (ids, same, back) in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == codec.original.encode(t or "") and same
        assert back == ("▁" not in (t or "")) and (not back or codec.decode([ids.tolist()]) == [t or ""])


def test_unigram_models_are_rebuilt(tmp_path):
    def piece(text, score, kind):
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    data = piece("<unk>", 0, 2) + piece("▁a", -1, 1) + piece("b", -2, 1) + piece("▁ab", -2.5, 1) + piece("▁", -3, 1)
    data += b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00"  # unigram; dummy prefix, white space kept
    spec = sentencepiece_codec.parse(data)
    assert spec.kind == sentencepiece_codec.UNIGRAM and len(spec.pieces) == 5 and not spec.remove_extra
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    tokenizer = sentencepiece_codec.build(spec)
    for text in ("ab", "a b", "abb ab", "b", ""):
        assert tokenizer.encode(text).ids == original.encode(text)


def proto(pieces, settings):
    out = b""
    for text, score, kind in pieces:
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind])
        out += b"\x0a" + bytes([len(body)]) + body
    return out + settings


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_ids_equal_the_originals_on_texts_that_read_like_pieces(tmp_path, fallback):
    """A model written by hand: control, unknown, unused, user-defined and byte pieces beside normal ones of several lengths."""
    import sentencepiece

    rng = np.random.default_rng(8)
    words = ["▁", "▁a", "b", "c", "a", "▁ab", "abc", "bc", "<", "0", "x", "4", "1", "s", ">", "▁the", "the", "t", "h", "e", "ca", "cab", "é"]
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("unused", -1, 5), ("<user>", 0, 4), ("[mask]", 0, 4)]
    pieces += [(f"<0x{k:02X}>", 0, 6) for k in range(256)] if fallback else []
    pieces += [(w, float(np.float32(-2 - 6 * rng.random())), 1) for w in words]
    data = proto(pieces, b"\x12\x05\x18\x01\x98\x02\x01" + b"\x1a\x04\x18\x01\x20\x00" if fallback else b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00")
    path = tmp_path / "m.model"
    path.write_bytes(data)
    codec = sentencepiece_codec.Codec(str(path))
    assert codec.spec.byte_fallback == fallback
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    parts = ["<s>", "</s>", "<unk>", "<0x41>", "<0xE2>", "unused", "<user>", "[mask]", "a", "b", "c", "the", " ", " ", "cab", "<0x4", "x", "€", "日", "é", "0", "<"]
    texts = ["a <s> b", "<unk> x", "<0x41> y", "</s>", *("".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 12))).strip() for _ in range(1000))]
    found = codec.encode(texts)
    assert [f[0].tolist() for f in found] == original.encode(texts) and all(f[1] for f in found)
    if fallback:
        plain = [t for t in texts if "  " not in t]
        assert codec.decode([f[0].tolist() for f in codec.encode(plain)]) == plain


def test_a_teaser_in_an_article_leaves_the_story_in_divs():
    story = [f"Paragraph {i} of the story that the page is about, told in plain divs and at some length for its readers." for i in range(6)]
    teaser = "Read next: another piece, told in some ninety characters, that this page only points at today."
    divs = "".join(f"<div>{p}</div>" for p in story)
    for page in (f"<div>{divs}</div><ul><li><a href=x>more</a></ul><article>{teaser}</article>", f"<article>{teaser}</article><hr><ul><li><a href=x>more</a></ul><div>{divs}</div>"):
        assert [t for t in html_text.main_text(page).split("\n") if t in story] == story
    article = "<article>" + "".join(f"<p>{p}</p>" for p in story) + "<p>End.</p></article>"
    assert html_text.main_text(f"<div>{teaser}</div>{article}<div>{teaser}</div>") == "\n".join([*story, "End."])


def test_ambiguous_names_inside_an_article_need_sparse_text():
    p = "A paragraph that belongs to the article as much as any other of its sections does."
    for names in ('id="discussion"', 'class="related-work"', 'class="social-policy"', 'class="search-results"', 'class="notice-period"'):
        assert html_text.main_text(f"<article><p>{p}</p><section {names}><h2>Head</h2><p>{p}</p><div class=share><a href=x>Share</a> it</div></section></article>") == f"{p}\nHead\n{p}"
    for sparse in ("<div class='related'><a href=x>Another piece that has a rather long title to it</a></div>", "<ul class='social'><li>Like<li>Share</ul>", "<div><span class=share>Share</span> <span class=share>Send</span></div>", f"<div class='comments'><p>{p}</p></div>", f"<aside>{p}</aside>"):
        assert html_text.main_text(f"<article><p>{p}</p>{sparse}<p>{p}</p></article>") == f"{p}\n{p}"
    assert html_text.main_text(f"<article><p>{p} The <span class='search-hit'>word</span> found.</p></article>") == f"{p} The word found."
    assert html_text.main_text(f"<p>{p}</p><div class='related'><p>{p}</p></div>") == p


def test_every_sentence_end_is_a_candidate():
    rng = np.random.default_rng(4)
    ends_sentence = np.arange(100) % 10 == 0
    ids = rng.integers(0, 100, 9000).astype(np.uint16)
    at, penalty = packing.candidates(ids, np.array([4000, 9000]), ends_sentence, 2048)
    stops = (np.flatnonzero(ends_sentence[ids]) + 1).tolist()
    assert set(at) == {0, 4000, 9000, *stops, *range(256, 9001, 256)}
    cost = dict(zip(at, penalty, strict=True))
    assert {cost[k] for k in set(stops) - {4000, 9000}} == {8} and cost[4000] == cost[9000] == 0


@pytest.mark.parametrize("good, bad, draws", [(5, 10**10, 10**9), (3 * 10**9, 4, 10**9), (10**10, 10**10, 7), (10**10, 5, 10**10 + 2)])
def test_counts_of_large_draws_are_exact(good, bad, draws):
    rng = np.random.default_rng(6)
    got = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000)])
    small, p = (good, draws / (good + bad)) if good < 10 else (bad, draws / (good + bad)) if bad < 10 else (draws, good / (good + bad))
    rare = draws - got if bad < 10 else got
    want = np.array([math.comb(small, k) * p**k * (1 - p) ** (small - k) for k in range(small + 1)])  # binomial: the rest is so large
    assert rare.min() >= 0 and rare.max() <= small and np.abs(np.bincount(rare, minlength=small + 1) / 4000 - want).max() < 0.03


def test_counts_beyond_the_limit_follow_the_law(monkeypatch):
    monkeypatch.setattr(sharding, "_LIMIT", 0)
    rng = np.random.default_rng(7)
    got = np.bincount([sharding.hypergeometric(rng, 9, 40, 30) for _ in range(8000)], minlength=10)
    want = np.array([math.comb(9, k) * math.comb(40, 30 - k) / math.comb(49, 30) for k in range(10)])
    assert np.abs(got / 8000 - want).max() < 0.02


LINE = "A long paragraph of the article's own words, with enough of them to count as text for the windows."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><p>{LINE}</p></div>',
        f'<div class="layout has-sidebar"><main><p>{LINE}</p></main><div class="sidebar">x y</div></div>',
        f'<div id="search-page"><article><p>{LINE}</p></article></div>',
        f'<div class="no-ads"><article><p>{LINE}</p></article></div>',
        f'<article><fieldset><p>{LINE}</p></fieldset></article>',
        f'<div class="page"><p>{LINE}</p></div><div class="comments"><article class="comment"><p>{LINE}</p></article></div>',
        f'<div class="page"><p>{LINE}</p></div><div class="sidebar"><p>{LINE}</p></div>',
    ],
)
def test_wrappers_named_like_boilerplate_keep_their_article(page):
    assert html_text.main_text(page) == LINE


@pytest.mark.parametrize("part", ['<a "', "<div></x>", "<div>", "<!x", "<b", "<article>a", "</p>", "<p class='"])
def test_malformed_pages_are_read_in_linear_time(part):
    import time

    began = time.process_time()
    html_text.main_text(part * (400_000 // len(part)))
    assert time.process_time() - began < 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-1, 1, width=32), min_size=32, max_size=32), min_size=6, max_size=40), st.integers(0, 5))
def test_a_scan_under_a_true_bound_finds_what_a_scan_without_finds(rows, q):
    x = np.array(rows) + 1e-3
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = np.sort(((u - u[q]) ** 2).sum(1)[np.arange(len(u)) != q])
    found = [nearest.scan(x, np.arange(len(x)), x[q], q, 5, u, u[q], bound) for bound in (np.inf, far[4] + 1e-9)]
    assert len(found[0]) == 5 and len(found[1]) <= 5 and {i for _, i in found[1]} <= {i for _, i in found[0]} | set(np.flatnonzero(np.abs(((u - u[q]) ** 2).sum(1) - far[4]) < 1e-6).tolist())
