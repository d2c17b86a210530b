"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; against brute force."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from learngraph.llm import embedding_duplicates, html_text, language_id, near_duplicates, nearest, packing, quality, sentencepiece_codec, sharding, shared, token_store

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, digest string, shard int, slot int, score double, item string"
LONG = " ".join(f"word{i % 53} and{i % 31}." for i in range(9000))
TEXTS = [(1, "one two three four five six"), (2, None), (3, ""), (4, LONG), (5, "one two three four five six"), (None, "no id here at all"), (6, "  double  spaces \n "), (6, "same id, other text"), (5, "one two three four five six")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "d", 9, 9, 0.5, "x") for i, t in TEXTS], CLASH).repartition(3).cache()


def ids_of(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs):
    pieces = packing.pack(docs, BYTE_BPE, size=256).collect()
    want = sorted((i or -1, len(x)) for (i, _), x in zip(TEXTS, ids_of([t for _, t in TEXTS], 1), strict=True))
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in pieces if r["start"] == 0) == want
    long_ids = ids_of([LONG], 1)[0]
    own = sorted((r for r in pieces if r["doc_id"] == 4), key=lambda r: r["start"])
    assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
    assert all(r["ids_crc32"] == crc(long_ids[r["start"] : r["start"] + r["length"]]) for r in own) and sum(r["length"] for r in own) == len(long_ids)
    fill = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 256 and sum(fill.values()) > 0.95 * 256 * (len(fill) - 3)
    assert packing.pack(docs.limit(0), BYTE_BPE).count() == 0


def test_token_shards(spark, docs):
    path = shared.new_path(spark, "shards")
    token_store.write_shards(docs, path, BYTE_BPE, shard_tokens=64)
    got = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 6]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    want = sorted(crc(x) for x in ids_of([t for _, t in TEXTS], 0))
    assert sorted(r["ids_crc32"] for r in got) == want
    empty = shared.new_path(spark, "shards")
    token_store.write_shards(docs.limit(0), empty, BYTE_BPE)
    assert token_store.read_documents(spark, empty).count() == 0


def test_sharding(docs):
    got = sharding.shuffle_into_shards(docs, 4, seed=1)
    assert set(got.columns) == set(docs.columns)
    found = got.collect()
    sizes = sorted(sum(r["shard"] == s for r in found) for s in range(4))
    assert sizes == [2, 2, 2, 3] and all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found))) for s in range(4))
    assert sorted(str((r["doc_id"], r["text"])) for r in found) == sorted(str((i, t)) for i, t in TEXTS)
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0


def test_sharding_is_uniform_and_repeats(spark):
    df = shared.written(spark.range(4000).repartition(5), "rows")
    a = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df, 8).collect()}
    assert a == {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df, 8).collect()}
    table = np.zeros((8, 8))
    for i, (s, _) in a.items():
        table[i // 500, s] += 1
    assert (table.sum(0) == 500).all() and ((table - 62.5) ** 2 / 62.5).sum() < 100  # chi-square of 49 degrees
    assert abs(np.corrcoef(list(a), [s * 500 + k for s, k in a.values()])[0, 1]) < 0.06


def brute_links(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                c = len(sets[a] & sets[b])
                if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    label[a] = label[b] = min(label[a], label[b])
    least = {g: min((rows[k][0] for k in range(len(rows)) if label[k] == g and rows[k][0] is not None), default=None) for g in set(label)}
    return [(len(s), least[g] if s else r[0]) for s, g, r in zip(sets, label, rows, strict=True)], label, sets


def variants(seed=0, n=60):
    """A chain of near copies in which texts drift apart, copies, and texts that share a passage only."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(25)]
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            base = list(base)
            base[rng.integers(60)] = f"x{i}"
            out.append(" ".join(base))
        elif kind == 1:
            out.append(" ".join(passage + [f"u{i}_{j}" for j in range(rng.integers(1, 30))]))
        elif kind == 2:
            out.append(out[rng.integers(len(out))].upper() if out else "first")
        else:
            own = list(base)
            for _ in range(rng.integers(1, 8)):
                own[rng.integers(60)] = f"y{i}_{rng.integers(9)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rows = [*enumerate(variants(words), 100), *[(i, t) for i, t in TEXTS if i != 4]]
    df = spark.createDataFrame([(i, t, "d", 9, 9, 0.5, "x") for i, t in rows], CLASH).repartition(4)
    want, _, _ = brute_links(rows, words, 80)
    got = near_duplicates.link(df, words=words).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, ((i, n, c) for (i, _), (n, c) in zip(rows, want, strict=True))))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_open_buckets_lose_no_link(spark, monkeypatch):
    """With tables so coarse that all texts meet in one bucket, links between others than its least class come from the exact join."""
    monkeypatch.setattr(near_duplicates, "_buckets", lambda classes: classes.select("digest").crossJoin(classes.agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("n"))).withColumn("bucket", F.lit(1)))
    rows = list(enumerate(variants(7, 80)))
    want, _, _ = brute_links(rows, 5, 80)
    got = near_duplicates.link(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, c) for (i, _), (_, c) in zip(rows, want, strict=True))


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = [*enumerate(variants(3), 100), *[(i, t) for i, t in TEXTS if i != 4]]
    df = spark.createDataFrame([(i, t, "d", 9, 9, 0.5, "x") for i, t in rows], CLASH)
    _, label, sets = brute_links(rows, 5, 80)
    kept = near_duplicates.deduplicate(df)
    assert kept.columns == df.columns
    found = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    assert len(found) == len({g for g, s in zip(label, sets, strict=True) if s}) + sum(not s for s in sets)
    assert set(found) <= {str(r) for r in rows}
    assert near_duplicates.deduplicate(df.limit(0)).count() == 0


def test_language_id(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog with that", "en"), ("der hund und die katze nicht das", "de")] * 20)] + [(100, None, "en"), (101, "12 !", None), (102, "", "de"), (None, "the dog", None), (103, LONG, None)]
    df = spark.createDataFrame([(*r, 0.1, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.fit(df, key=F.col("doc_id"))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert model.langs == ["de", "en"] and [got[i]["lang_pred"] for i in (0, 1, None)] == ["en", "de", "en"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102)) and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.fit(df.limit(0), key=F.col("doc_id"))
    assert {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"}
    judged = df.select("doc_id", language_id.verdict(df, model).alias("v")).collect()
    assert {r["doc_id"]: r["v"]["lang_pred"] for r in judged} == {i: r["lang_pred"] for i, r in got.items()}


def test_quality(spark):
    rows = [(i, ("a calm line of words, as one writes.\n" if i % 2 else "LOUD!! WORDS!! ALL!! ") * (3 + i % 5)) for i in range(80)] + [(200, None), (201, ""), (None, "no id"), (202, LONG)]
    df = spark.createDataFrame([(*r, 0.2) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (2, None), (None, 1), (999, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(80)) and all(0 <= s <= 1 for s in got.values()) and len(got) == 84
    flat = quality.fit(df, labels.where("quality = 1"))
    assert flat.weights is None and {r["score"] for r in quality.score(df, flat).collect()} == {1.0}
    assert quality.fit(df, labels.limit(0)).rate == 0.5
    assert {r["doc_id"]: round(r["v"], 9) for r in df.select("doc_id", quality.verdict(df, model).alias("v")).collect()} == {i: round(s, 9) for i, s in got.items()}


VECTORS = "vec_id long, embedding array<float>, digest string, raw int, score double"


def vector_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [v.tolist() for v in base] + [(base[k % 5] + rng.normal(size=16) * s).tolist() for k, s in enumerate(np.linspace(0.05, 0.5, 40))] + [base[0].tolist()] * 4
    rows += [None, [0.0] * 16, [1.0] * 15, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, []]
    return [(i, v, "d", 1, 0.5) for i, v in enumerate(rows)]


def usable(rows):
    keep = [(r[0], np.array(r[1], np.float32).astype(float)) for r in rows if r[1] and len(r[1]) == 16 and None not in r[1]]
    keep = [(i, v) for i, v in keep if np.isfinite(v).all() and v.any()]
    return [i for i, _ in keep], np.stack([v / np.linalg.norm(v) for _, v in keep])


def test_embedding_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embedding_duplicates, "BLOCK", 8)
    rows = vector_rows()
    got = {r["vec_id"]: r for r in embedding_duplicates.link(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    ids, u = usable(rows)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in ids:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
    assert len(got) == len(rows)
    assert sum(got[i]["n_links"] for i in ids) >= 0.98 * near.sum() and all(got[i]["n_links"] <= near[k].sum() for k, i in enumerate(ids))
    assert np.mean([got[i]["component_id"] == label[k] for k, i in enumerate(ids)]) > 0.97
    for i in set(got) - set(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding_duplicates.link(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest(spark):
    rows = vector_rows()
    got = nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 3 == 0).collect()
    ids, u = usable(rows)
    hits = total = 0
    for k, i in enumerate(ids):
        own = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
        if i % 3:
            assert not own
            continue
        s = u @ u[k]
        s[k] = -9
        want = [ids[j] for j in np.lexsort((ids, -np.round(s, 12)))[:5]]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and i not in {r["vec_id"] for r in own}
        assert all(abs(r["score"] - s[ids.index(r["vec_id"])]) < 1e-12 for r in own)
        hits, total = hits + len(set(want) & {r["vec_id"] for r in own}), total + 5
    assert hits >= 0.9 * total and {r["query_id"] for r in got} <= set(ids)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["rank"], r["vec_id"]) for r in nearest.search(few, F.col("vec_id") == 0).collect()) == [(1, 1), (2, 2)]
    assert nearest.search(few.limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest.search(few.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_html(spark):
    rows = [(1, "u", "<article><p>a &lt; b</p></article>", "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", "<p>x", "t"), (1, "u", "<article><p>a &lt; b</p></article>", "t")]
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [("1", "a < b", 5), ("1", "a < b", 5), ("2", "", 0), ("3", "", 0), ("None", "x", 1)]


def test_sentencepiece(docs):
    coded = sentencepiece_codec.encode(docs, PIECES).cache()
    assert coded.where("NOT parity OR NOT round_trip").count() == 0
    back = sorted(str((r["doc_id"], r["text"])) for r in sentencepiece_codec.decode(coded, PIECES).collect())
    assert back == sorted(str((i, t or "")) for i, t in TEXTS)
    assert sentencepiece_codec.encode(docs.limit(0), PIECES).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = [f"a calm line number {i} of plain words about topic {i * 7}, as one writes in thing {i * 13}.\n" * 4 for i in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(100 + i, "LOUD!! WORDS!! ALL!! DAY!! " * 12 + str(i), "en") for i in range(40)]
    rows += [(200, good[0], "en"), (201, good[1].upper().lower(), "en"), (202, "123 456 !", "en"), (203, None, None), (204, "Это текст на другом языке и письме", None)]
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == {r[0] for r in rows} - {202, 203, 204}
    assert kept[1] == set(range(40)) | {200, 201} and kept[2] == set(range(40))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(40))


WORDS = {
    "en": "the and of that with this from there which would about their after water people house little never again between small river because another through morning",
    "de": "der und die das nicht ist mit einer auch werden zwischen kleine haus wasser menschen immer wieder durch nach morgen fluss weil andere niemals darüber",
}
FOREIGN = {
    "fi": "tämä on suomenkielinen teksti jota malli ei ole koskaan nähnyt aikaisemmin missään muodossa eikä sen kieltä ole opittu yhdestäkään rivistä",
    "tr": "bu modelin daha önce hiç görmediği türkçe bir metindir ve uzun kelimeler içerir böylece hiçbir satırdan öğrenilmiş olamaz",
    "salad": "xqzt vrplk wwqj zzkrt bnmtq plkjh qqwx zxcvb mnbvq kjhgf xzqpw vvbtr qwpzk jjxqv",
}


def test_language_stage_drops_unlearned_languages_of_a_learned_script(spark):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    draw = lambda g, n: " ".join(rng.choice(WORDS[g].split(), n))
    rows = [(i, draw(g, int(rng.integers(3, 60))), g) for i, g in enumerate(["en", "de"] * 100)]
    plain = [(1000, draw("en", 40)), (1001, draw("de", 40)), (1002, draw("en", 30) + " " + draw("de", 30)), (1003, "water"), (1004, draw("en", 5000))]
    strange = [(2000 + i, t * k) for i, (t, k) in enumerate((t + " ", k) for t in FOREIGN.values() for k in (1, 20))]
    docs = spark.createDataFrame([*rows, *((i, t, None) for i, t in plain + strange)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {r[0] for r in rows} | {i for i, _ in plain}


def test_quality_keeps_a_rare_label_in_full(spark):
    rows = [(i, ("LOUD!! WORDS!! ALL!! " if i in (77, 333) else "a calm line of words, as one writes.\n") * (3 + i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in (77, 333))) for i in range(600)], "doc_id long, quality int")
    model = quality.fit(df, labels, max_rows=40)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert model.weights is not None and model.rate == 598 / 600
    assert max(got[77], got[333]) < min(s for i, s in got.items() if i not in (77, 333))
    assert np.mean([s for i, s in got.items() if i not in (77, 333)]) > 0.98


def test_quality_learns_from_all_passages_of_whole_rows(spark, monkeypatch):
    rows = [(i, ("a calm line of words, as one writes.\n" if i % 2 else "LOUD!! WORDS!! ALL!! ") * (3000 if i < 2 else 10)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    taken, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda x, owner, y: taken.append((np.bincount(owner), y)) or train(x, owner, y))
    quality.fit(df, labels)
    whole = [len(quality.passages([t])[0]) for _, t in rows]
    assert max(whole) > 64 and taken[0][0].tolist() == whole
    monkeypatch.setattr(quality, "MAX_PASSAGES", 20)
    assert quality.fit(df, labels).weights is not None
    sizes, y = taken[1]
    assert 1 <= sum(y == 0) <= 10 and 1 <= sum(y == 1) <= 10 and set(sizes.tolist()) <= set(whole)


def test_columns_of_any_name_travel_along(spark):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "file", "at", "to", "id", "digest", "root", "rank", "place", "__judged", "__score", "__id"]
    rows = [(i, t, "en", *["x"] * 11) for i, t in enumerate(["the cat and the dog with that", "the cat and the dog with that", "a word of this", "12"] * 3)] + [(0, "another text of id zero", "en", *["x"] * 11), (None, None, None, *["y"] * 11)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    placed = sharding.shuffle_into_shards(df, 2)
    assert set(placed.columns) == {*names, "shard", "slot"} and placed.drop("shard", "slot").exceptAll(df).isEmpty() and placed.count() == len(rows)
    kept = near_duplicates.deduplicate(df)
    assert kept.columns == names and kept.exceptAll(df).isEmpty() and {r["text"] for r in kept.collect()} == {r[1] for r in rows}
    judged = corpus_pipeline.identify_language(spark, df, "")
    assert judged.columns == names and {(r["__judged"], r["__score"]) for r in judged.collect()} == {("x", "x")}


def test_marks_alone_are_no_letters(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("el perro y la casa", "es"), ("the dog and the house", "en")] * 10)] + [(100, "́̂ 12", None), (101, "café y la casa", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.fit(df, key=F.col("doc_id"))).collect()}
    assert (got[100]["lang_pred"], got[100]["score"], got[100]["spans"]) == ("und", 0, []) and got[101]["lang_pred"] == "es"
