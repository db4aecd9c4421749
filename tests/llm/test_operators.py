"""Each operator against a plain statement, on hard rows: nulls, empties, ties, repeats, odd columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import contaminated, entities, jaccard_components, without_repeats
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliomark.llm import (
    bits,
    decontaminate,
    jaccard_join,
    language_id,
    nn_descent,
    packing,
    pii,
    quality,
    substring,
    token_counts,
    url_filter,
)
from foliomark.llm.encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row_id string, words array<int>, n long, lang string, score int"


def docs_of(spark, rows):
    """Texts in a table with nulls elsewhere and column names that the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, k, None, k) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Émile", "naïve", "日本", "x-y", "Don't", "3.14"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 6, 40, 120]))]
        if i % 4 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    base = rows[-1][1].split() or passage
    for i in range(60, 75):  # near copies, some repeated
        words = list(passage * 2 + base)
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(75, None), (76, ""), (77, " \n "), (78, "a b c"), (79, "A B C"), (80, " ".join(["same"] * 90)), rows[60], rows[60]]
    rows += [(None, rows[60][1]), (None, None), (81, "so " * 3000 + "end")]
    return rows


def same(found, expected):
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_jaccard_join(spark, texts):
    found = jaccard_join.joined(docs_of(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    same(found, jaccard_components(texts))


def test_one_of_each_group_stays(spark, texts):
    groups = jaccard_join.joined(docs_of(spark, texts))
    kept = groups.join(jaccard_join.first_of_each(groups), "row_id")
    assert kept.count() == groups.select("group_id").distinct().count()
    assert kept.filter("n_shingles = 0").count() == groups.filter("n_shingles = 0").count()


def test_big_blocks_are_cut_and_stay_whole(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    found = jaccard_join.joined(docs_of(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    same(found, jaccard_components(texts))


def test_chains_around_the_threshold(spark, monkeypatch):
    """Groups in which most pairs just fail and some just hold, settled in blocks of any size."""
    rng = random.Random(12)
    rows = []
    for group in range(6):
        words = [f"g{group}w{k}" for k in range(rng.choice([12, 60, 150]))]
        for _ in range(25):
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            some = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                some[rng.randrange(len(some))] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(some)))
    expected = jaccard_components(rows)
    for block, shingles in ((2048, 1 << 20), (4, 1 << 20), (2048, 200)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles)
        found = jaccard_join.joined(docs_of(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
        same(found, expected)


def test_fine_counts_lose_no_link():
    rng = np.random.default_rng(3)
    sets = []
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for _ in range(40):
        some = np.unique(np.concatenate([rng.choice(base, rng.integers(150, 290), replace=False), rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)]))
        sets.append(some)

    def counts(x, groups):
        return jaccard_join.from_nibbles(jaccard_join.nibbles(np.bincount((x % np.uint64(groups)).astype(np.int64), minlength=groups)))

    sizes = np.array([len(x) for x in sets])
    fine = [counts(x, jaccard_join.fine_number(len(x))) for x in sets]
    coarse = [counts(x, jaccard_join.group_number(len(x))) for x in sets]
    points = jaccard_join.Candidates(sizes, coarse, fine)
    found = {(min(i, j), max(i, j)) for i in range(40) for j in points.similar(i, points.near(i)).tolist() if i != j}
    for i in range(40):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            assert jaccard_join._shared(sets[i], sets[j]) == shared
            if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                assert (j, i) in found


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(1)
    counts = rng.poisson(3, (500, jaccard_join.LEAST_GROUPS)).astype(np.int64)
    sizes = counts.sum(axis=1)
    tree = jaccard_join.RTree(counts, sizes)
    for i in range(0, 500, 50):
        near = set(tree.search(counts[i], int(sizes[i])).tolist())
        for j in range(500):
            fits = 7 * np.minimum(counts[i], counts[j]).sum() >= 3 * (sizes[i] + sizes[j])
            fits &= 4 * sizes[j] >= 3 * sizes[i] and 3 * sizes[j] <= 4 * sizes[i]
            assert (j in near) == fits


@pytest.mark.parametrize("bucket_windows", [substring.BUCKET_WINDOWS, 5])
def test_substring(spark, texts, bucket_windows):
    found = substring.remove_repeats(docs_of(spark, texts), window=35, bucket_windows=bucket_windows).collect()
    same(found, without_repeats(texts, 35))


def test_substring_short_windows(spark, texts):
    found = substring.remove_repeats(docs_of(spark, texts), window=12, gram=4).collect()
    same(found, without_repeats(texts, 12))


def test_decontamination(spark, texts):
    items = [(0, texts[0][1]), (1, "a b c"), (2, None), (3, "!?"), (4, texts[4][1]), (4, texts[4][1]), (None, texts[61][1]), (10, "日本")]
    bench = spark.createDataFrame([(i, t, None) for i, t in items], "item_id long, text string, words string")
    found = decontaminate.contained_items(docs_of(spark, texts), bench).select("doc_id", "n_words", "n_hit", "item_ids").collect()
    same([(r[0], r[1], r[2], sorted(map(str, r[3]))) for r in found], contaminated(texts, items))


def test_personal_data(spark):
    rows = [
        (0, "mail a.b@c-d.org, x@y.z.w_v@u.tv and é@b.co 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255"),
        (1, "4111 1111 1111 1111 4111-1111-1111-1112 +1 (377) 555-0271 +12 34"),
        (2, None),
        (3, ""),
        (4, 'token = "abc123def456" and 日本 secret: a1b2c3d4e5 end'),
        (5, "a@" * 3000 + "b.c" + "1" * 5000 + " " + "9.9.9.9 " * 700),
        (None, "4111111111111111"),
        (None, "4111111111111111"),
    ]
    rng = random.Random(3)
    rows += [(10 + k, "".join(rng.choice(["a", "@", ".", "1", "4", "-", " ", "+", "(", ")", "é", "255", "5", "😀"]) for _ in range(80))) for k in range(300)]
    found = pii.personal_data(docs_of(spark, rows)).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()
    same([(r[0], [x for x in r[1].split(",") if x and x[:3] != "id:"]) for r in found], [(i, entities(t)) for i, t in rows])


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f'some words token = "{i:04d}abcdef{i:04d}" then more') for i in range(20)] + [(50, "in version 2024beta1 of it")]
    found = dict(pii.personal_data(docs_of(spark, rows)).select("doc_id", pii.written(F.col("spans"))).collect())
    assert all(found[i] == "id:20:34" for i in range(20))
    assert found[50] == ""


def test_base_entities_seed_contexts(spark):
    # ids without any naming word, one for each kind of base entity whose contexts they share
    contexts = {"reached from": "{}.1.2.3", "please call": "+1 (377) 555-38{}", "mail for": "ab{}@c.org", "paid with": "{}"}
    numbers = {"paid with": ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004"]}
    rows, unseen = [], []
    for context, entity in contexts.items():
        for k in range(4):
            value = numbers[context][k] if context in numbers else entity.format(20 + k)
            rows.append((len(rows), f"on 2024-05-0{k} we {context} {value} today"))
        unseen.append((len(rows), f"on 2024-06-01 we {context} zq77x-{len(rows)} today"))
        rows.append(unseen[-1])
    rows.append((len(rows), "in version 2024beta1 of it"))
    found = dict(pii.personal_data(docs_of(spark, rows)).select("doc_id", pii.written(F.col("spans"))).collect())
    for i, text in unseen:
        assert found[i] == f"id:{text.index('zq77x')}:{text.index(' today')}"
    assert found[len(rows) - 1] == ""


def test_named_values_are_spans(spark):
    values = {
        'x token = "abc123def456" and': "abc123def456",
        "y 日本 secret: a1b2c3d4e5 end": "a1b2c3d4e5",
        "our ssn: 123-45-6789": "123-45-6789",
        'the password = "correct horse battery" here': "correct horse battery",
        "a PASSWD:hunter end": "hunter",
        "an api-key = 'it is \"x\"'": 'it is "x"',
        "two token: secret: q7": "q7",
        'open token = "k9z and no more': "k9z",
        'curl "token: k9z" now': "k9z",
        'none token = "" here': None,
        "known password: a@b.org here": None,
        "partly password: x!a@b.org here": "x!a@b.org",
    }
    rows = list(enumerate(values)) + [(100 + k, f"word{k} secret: s3cr3tcopy") for k in range(5)]
    found = {r.doc_id: r.spans for r in pii.personal_data(docs_of(spark, rows)).collect()}
    for i, text in rows:
        value = values.get(text, "s3cr3tcopy")
        ids = [(s["start"], s["end"]) for s in found[i] if s["rank"] == pii.KINDS.index("id")]
        assert [text[a:b] for a, b in ids] == ([value] if value else []), text


def test_one_unit_contexts_discover(spark):
    rows = [(k, f"w{k} secret: s3cr3t{k}") for k in range(5)] + [(10, "we mail 55zq55 now")]
    rows += [(20 + k, f"v{k} mail u{k}@b.org") for k in range(5)]
    found = dict(pii.personal_data(docs_of(spark, rows)).select("doc_id", pii.written(F.col("spans"))).collect())
    assert found[10] == "id:8:14" and all(found[k] for k in range(5))


def test_redaction(spark):
    df = docs_of(spark, [(1, "é x@y.zz and 4111111111111111!"), (2, "nothing")])
    spans = pii.base_spans(F.col("text"))
    done = df.withColumn("spans", spans).select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [r.t for r in done] == ["é [EMAIL] and [CARD]!", "nothing"]


def hard_texts():
    rng = random.Random(4)
    pieces = ["a", "The", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", "\n", ".", ",", "é", "́", "Σ", "İ", "12", "\x1c", "\xa0", "中", "😀", "don't", "\t", "A.b"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(800)]


def test_word_encoder_is_the_library():
    some = hard_texts()
    ids, begins = WordEncoder(PATH).encode(pa.array(some))
    library = Tokenizer.from_file(PATH)
    for k, e in enumerate(library.encode_batch(some, add_special_tokens=False)):
        assert ids[begins[k] : begins[k + 1]].tolist() == e.ids


@pytest.mark.parametrize(("chunk", "overlap"), [(token_counts.CHUNK, token_counts.OVERLAP), (60, 4), (200, 50)])
def test_token_counts(spark, chunk, overlap):
    rows = list(enumerate(hard_texts()))[:200]
    rows += [(900, "x" * 700), (901, ("y" * 150 + " ") * 9), (902, None), (903, ""), (None, "a b"), (None, "a b"), (904, "word " * 9000)]
    library = Tokenizer.from_file(PATH)
    found = token_counts.count_tokens(docs_of(spark, rows), PATH, chunk, overlap).select("doc_id", "n_bytes", "n_tokens").collect()
    same(found, [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows])


def test_packing(spark, texts):
    library = Tokenizer.from_file(PATH)
    rows = [(k, t) for k, (_, t) in enumerate(texts)]
    found = packing.packed(docs_of(spark, rows), PATH, length=64, keep_ids=True).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    sequences, covered = defaultdict(list), Counter_of(found)
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert part == list(r.ids) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == {i: len(x) for i, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(covered.values()) > 0.9 * 64 * len(sequences)


def Counter_of(found):  # noqa: N802
    out = defaultdict(int)
    for r in found:
        out[r.doc_id] += r.length
    return dict(out)


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, 300)
    bins, _ = packing.first_fit_decreasing(lengths, 64)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        first = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if first == len(room):
            room.append(64)
        room[first] -= lengths[i]
        assert bins[i] == first


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.example.COM/en/x?y#z", "http://www.example.com/en/", "http://example.com/fr/", "http://xcom/",
        "http://a.net/es/q", "http://net/fr/", "http://a.net/esx", "http://casino.org/", "http://a.org?x/y", "http://b.org#://c.com/", "x://y://z.com/",
        "http://a.com", "http://spam-a.org/" + "p" * 5000, "http://a.org/é.com\0/en/",
    ]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id long, url string, rule string")

    def plain(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, tail = rest.partition("/")
        host, path = host.lower(), slash + tail
        fitting = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        if fitting:
            verdict, h, p = max(fitting, key=lambda r: len(r[1] + r[2]))
            return host, path, h + p, verdict
        return host, path, None, "block" if "casino" in host or "spam-" in host else "allow"

    same(url_filter.judged(pages).collect(), [(k, *plain(u)) for k, u in enumerate(urls)])


def test_wildcards():
    automaton = url_filter.ShiftAnd(["a*b", "*", "?", "", "x" * 70 + "*y"])
    texts = ["ab", "axxb", "abx", "", "a", "x" * 70 + "qqy", "x" * 69 + "y"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    fits = automaton.run(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert fits.astype(int).tolist() == [
        [1, 1, 0, 0, 0], [1, 1, 0, 0, 0], [0, 1, 0, 0, 0], [0, 1, 0, 1, 0], [0, 1, 1, 0, 0], [0, 1, 0, 0, 1], [0, 1, 0, 0, 0]
    ]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nn_descent(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    near = base[:20] + rng.normal(0, 0.01, (20, 16))
    crowd = base[0] + rng.normal(0, 0.01, (60, 16))
    rows = [v.astype("f4").tolist() for v in (*base, *near, *crowd, base[3], base[3], 2 * base[4])]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None, *[1.0] * 15], [float("inf"), *[1.0] * 15], [1.0, 2.0]]
    table = [(k, v, 1) for k, v in enumerate(rows + odd)] + [(None, rows[5], 1)]
    found = nn_descent.near_duplicates(spark.createDataFrame(table, f"vec_id long, embedding array<{kind}>, sim int")).collect()
    unit = np.array(rows + [rows[5]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in found}
    assert [got[k].n_links for k in range(len(rows))] == links[:-1].tolist()
    assert got[None].n_links == links[-1] and got[None].component_id == 5 and not got[None].kept
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(len(rows), len(rows) + len(odd)))
    assert got[170].component_id == 0 and got[0].kept and not got[170].kept


def test_audit_counts_small_components(spark):
    rng = np.random.default_rng(5)
    vectors = [v for _ in range(20) for v in [rng.standard_normal(16)] * 2]
    vectors = np.array([*vectors, *[rng.standard_normal(16)] * 200]) + rng.normal(0, 0.001, (240, 16))
    nodes = spark.createDataFrame([(k, v.astype("f4").tobytes(), 1) for k, v in enumerate(vectors)], "node long, packed binary, n long")
    whole = [(k, 1 if k < 40 else 199) for k in range(240)]
    shares = []
    for missed in (0, 10, 40):  # pairs that nothing has found
        found = spark.createDataFrame([(k, m, m) for k, m in whole[missed:]], "node long, links long, others long")
        shares.append(nn_descent.audit(nodes, found, 0.95, "<f4", 1))
    assert shares == [1.0, 0.75, 0.0]


def test_failed_audit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "AUDITS", 1)
    monkeypatch.setattr(nn_descent, "audit", lambda *_: 0.5)
    vectors = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="0.5000"):
        nn_descent.near_duplicates(vectors)


def test_partitions_follow_depth():
    for depth in (0, 7, 13, 17):
        shared = (1 - np.arccos(0.95) / np.pi) ** depth
        assert 1 - (1 - shared) ** nn_descent.partitions(depth, 0.95) >= 0.99


def test_language_id(spark):
    rows = [(i, "the house and the garden of them", "en") for i in range(20)] + [(i, "das haus und der garten von ihnen", "de") for i in range(20, 40)]
    labelled = spark.createDataFrame([*rows, (40, None, "en"), (41, "und", None)], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    asked = [(1, "the garden"), (2, "der garten und das haus"), (3, None), (4, ""), (5, "123 !"), (6, "the house and the garden der garten und das haus " * 50), (7, "x" * 50_000)]
    found = {r.doc_id: r for r in language_id.identify(docs_of(spark, asked), model).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"]
    assert sorted(found[6].languages) == ["de", "en"] and 0.3 < found[6].score < 0.7
    assert found[7].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.lang_pred == "und" for r in language_id.identify(docs_of(spark, asked), language_id.train(labelled.limit(0))).collect())


def test_texts_in_many_languages(spark):
    words = {
        "de": "das haus und der garten von ihnen", "en": "the house with this garden where they live", "fi": "talossa asuvat vanhemmat puutarha kylmä",
        "fr": "elle avait toujours quelque chose pour eux", "pl": "przez cały dzień było bardzo zimno",
    }
    model = language_id.train(spark.createDataFrame([(t, lang) for lang, t in words.items() for _ in range(20)], "text string, lang string"))
    asked = [" ".join(f"{words[lang]} " * 40 for lang in some) for some in (["de"], ["de", "en", "fi", "fr"], list(words))]
    shares, n = language_id.proportions(model, pa.array(asked))
    assert [[lang for lang, x in zip(model.languages, row, strict=True) if x > 0] for row in shares] == [["de"], ["de", "en", "fi", "fr"], list(words)]
    for lang, share in zip(model.languages, shares[2].tolist(), strict=True):
        assert abs(share - 40 * len(words[lang].split()) / n[2]) < 0.02


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    found = language_id.op1_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    right, total = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert total > 10 and right > 0.95


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rates = {r.quality: r.kept for r in found.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.95 and rates[0] < 0.3
    odd = quality.scored(docs_of(spark, [(1, None), (None, ""), (2, "x" * 100_000), (2, "x" * 100_000)])).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.joined(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert decontaminate.contained_items(none, items).count() == 0
    assert pii.personal_data(none).count() == 0
    assert token_counts.count_tokens(none, PATH).count() == 0
    assert packing.packed(none, PATH).count() == 0
    assert quality.scored(none).count() == 0
    assert language_id.identify(none, language_id.train(none)).count() == 0
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_documents_without_benchmark(spark, texts):
    found = decontaminate.contained_items(docs_of(spark, texts), spark.createDataFrame([], "item_id long, text string"))
    assert found.count() == len(texts) and found.filter("n_hit > 0").count() == 0


def test_scores_do_not_follow_files(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    table = table.union(table.filter("doc_id % 7 = 0"))
    found = []
    for files in (1, 2, 7):
        path = f"{tmp_path}/{files}"
        table.orderBy(F.xxhash64("doc_id", F.lit(files))).repartition(files).write.parquet(path)
        some = quality.scored(spark.read.parquet(path), fit_rows=40).collect()
        found.append(sorted((r.doc_id, r.label, r.score) for r in some))
    assert found[0] == found[1] == found[2]


def test_label_model_against_plain_statement():
    rng = np.random.default_rng(3)
    names = list(quality.VOTERS)
    good = rng.random(400) < 0.6
    rates = {name: (0.1, 0.7) if vote == quality.GOOD else (0.6, 0.05) for name, vote in quality.VOTERS.items()}
    votes = np.array([[quality.VOTERS[n] if rng.random() < rates[n][int(g)] else quality.ABSTAIN for n in names] for g in good])
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, n.astype(float))
    # the same, text by text
    share = [0.1 if quality.BAD in row else 0.9 for row in votes.tolist()]
    for _ in range(quality.EM_ROUNDS):
        weight = [sum(1 - s for s in share), sum(share)]
        rate = [
            [(sum((s if c else 1 - s) for s, row in zip(share, votes.tolist(), strict=True) if row[k] != quality.ABSTAIN) + 0.5) / (weight[c] + 1)
             for k in range(len(names))] for c in (0, 1)
        ]
        prior = (weight[1] + 1) / (sum(weight) + 2)
        after = []
        for row in votes.tolist():
            both = [1 - prior, prior]
            for c in (0, 1):
                for k, vote in enumerate(row):
                    both[c] *= rate[c][k] if vote != quality.ABSTAIN else 1 - rate[c][k]
            after.append(both[1] / sum(both))
        share = after
    assert np.abs(model.posterior(votes) - np.array(share)).max() < 1e-3
    assert ((np.array(share) > 0.5) == good).mean() > 0.9 and all(model.accuracy()[name] > 0.7 for name in names)


def test_mixtures_against_plain_statement():
    rng = np.random.default_rng(4)
    sizes = [1, 2, 30, 200]
    likely = rng.random((sum(sizes), 3)).astype(np.float32) ** 4 + 1e-6
    found, _ = language_id._settled(likely, np.full((4, 3), 1 / 3, dtype=np.float32), np.array(sizes))
    for k, size in enumerate(sizes):
        rows, share = likely[sum(sizes[:k]) :][:size].astype(float), [1 / 3] * 3
        moved = 1.0
        while moved > language_id.STILL:
            each = [[s * x / sum(a * b for a, b in zip(share, row, strict=True)) for s, x in zip(share, row, strict=True)] for row in rows.tolist()]
            after = [sum(column) / size for column in zip(*each, strict=True)]
            moved, share = max(abs(a - b) for a, b in zip(after, share, strict=True)), after
        assert np.abs(found[k] - share).max() < 1e-3


def test_rows_apart_by_bits(spark):
    rows = spark.range(5000).select(F.col("id").alias("row_id"), F.lit("x").alias("c"))
    ids = rows.filter("row_id % 97 = 3").select("row_id")
    may, clear = bits.parted(rows, ids, "row_id")
    assert may.count() + clear.count() == 5000 and may.join(ids, "row_id").count() == ids.count() and may.count() < 100
    assert sorted(r.row_id for r in bits.without(rows, ids, "row_id").collect()) == [k for k in range(5000) if k % 97 != 3]
    assert bits.without(rows, ids.limit(0), "row_id").count() == 5000
    plan = bits.without(rows, ids, "row_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _overlapping(text):
    """What instances has to give but patterns, by comparing every token with everything."""
    base = [tuple(map(int, e.split(":")[1:])) for e in entities(text)]
    tokens = [(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+", text)]
    free = [(a, b) for a, b in tokens if b - a >= pii.SHORTEST and not any(c < b and a < d for c, d in base)]
    return sorted([(a, b, True) for a, b in base] + [(a, b, False) for a, b in free])


def test_instances_against_all_pairs(spark):
    rng = random.Random(6)
    pieces = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (377) 555-0271", "zz99zz9", "-", " ", ".", "12345678", "é", "+44 1234567890123", "x1", "@"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(200)] + [" ".join(rng.choice(pieces) for _ in range(1200))]
    df = docs_of(spark, list(enumerate(texts)))
    found = pii.instances(F.col("text"), pii.base_entities(F.col("text")), F.array().cast(pii.FOUND_TYPE))
    for r in df.select("text", found.alias("f")).collect():
        assert sorted((x.start, x.end, x.seed) for x in r.f) == _overlapping(r.text)


def test_redaction_of_many_spans(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcé😀 ") for _ in range(9000))
    spans = sorted((rng.randrange(8900), rng.randrange(5)) for _ in range(700))
    spans = [(a, rank, a + rng.randrange(1, 60 if k % 90 == 0 else 9)) for k, (a, rank) in enumerate(spans)]
    out, at = [], 0
    for a, rank, b in spans:
        if a >= at:
            out += [text[at:a], f"[{pii.KINDS[rank].upper()}]"]
        at = max(at, b)
    row = [(text, [(rank, a, b) for a, rank, b in spans])]
    found = spark.createDataFrame(row, f"text string, spans array<{pii.SPAN}>").select(pii.redacted(F.col("text"), F.col("spans"))).first()[0]
    assert found == "".join(out) + text[at:]
