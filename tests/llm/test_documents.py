"""Document operators on hand-made rows, against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

line_dedup = pytest.importorskip("chainlens.llm.line_dedup")
from chainlens.llm import language_id, mixing, near_dups, packing, quality  # noqa: E402

WHITE = " \t\n\x0b\f\r"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "n_lines string, size string, copies string, score string, _h1 string, key string, id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def with_clashing(df):
    for name in re.findall(r"(\w+) string", CLASHING):
        df = df.withColumn(name, F.lit("kept"))
    return df


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    lines = [" ".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(60)]
    rows = []
    for i in range(150):
        own = [" ".join(rng.choices(pool, k=rng.randrange(0, 30))) + "." for _ in range(rng.randrange(1, 6))]
        own += rng.choices(lines, k=rng.randrange(0, 3))
        rng.shuffle(own)
        rows.append((i, "\n".join(own), rng.choice(["xx", "yy"]), rng.choice(["a", "b", "b", "b", None]), 0))
    base = rng.choices(pool, k=120)
    for i in range(150, 210):  # a group of near copies, and within it exact ones
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "xx", "b", 0))
    rows += [(210, " ".join(base), "xx", "b", 0), (211, None, None, None, None), (212, "", "xx", "a", 0), (213, " \n\t", "yy", "a", 3),
             (214, "one two", "xx", "c", 7), (215, "ONE  two", "xx", "c", 7), (216, "12 ++", "yy", "c", 5),
             (217, "A much Longer line\r\n\x0ba much longer LINE ", "xx", None, 9), (218, "word " * 30_000, "xx", "a", 150_000)]
    return rows


def lines_by_hand(rows):
    first = {}
    parts = {}
    for doc, text, *_ in rows:
        parts[doc] = [(line, lowered(line.strip(WHITE))) for line in (text or "").split("\n")]
        for _, key in parts[doc]:
            first[key] = min(first.get(key, doc), doc)
    kept = {d: [line for line, key in own if len(key) < 10 or first[key] == d] for d, own in parts.items()}
    return {d: (len(parts[d]), len(parts[d]) - len(kept[d]), "\n".join(kept[d])) for d in parts}


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (5, 3)])
def test_lines_match_plain_python(spark, corpus, batches, fanout):
    made = line_dedup.dedup_lines(with_clashing(frame(spark, corpus)), batches=batches, fanout=fanout)
    expect = lines_by_hand(corpus)
    rows = made.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r["n_lines"], r["n_dropped"], r["text"] or "") == expect[r["doc_id"]]
        assert (r["text"] is None) == (r["doc_id"] == 211) and r["_h1"] == r["key"] == "kept"


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(1, "the same line here"), (1, "the same line here"), (None, "the same line here\nx"), (None, "only without an id"),
            (None, "only without an id"), (2, "The Same line here ")]
    made = line_dedup.dedup_lines(frame(spark, rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in made) == sorted(
        [(1, rows[0][1]), (1, rows[0][1]), (0, "x"), (0, rows[3][1]), (0, rows[3][1]), (2, "")])


def test_a_line_in_most_documents_and_an_empty_table(spark):
    rows = [(i, f"a very common line\nline of {i} alone") for i in range(3000)]
    made = line_dedup.dedup_lines(frame(spark, rows, "doc_id bigint, text string"))
    assert made.agg(F.sum("n_dropped")).first()[0] == 2999
    assert made.where("n_dropped = 0").collect()[0]["doc_id"] == 0
    empty = line_dedup.dedup_lines(frame(spark, [], SCHEMA))
    assert empty.count() == 0 and empty.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    own = words(lowered(text or ""))
    return {tuple(own[i: i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def components_by_hand(rows, percent):
    sets = {doc: shingles(text) for doc, text, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, corpus, percent):
    found = near_dups.near_duplicates(with_clashing(frame(spark, corpus).repartition(7)), percent=percent).collect()
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in found} == components_by_hand(corpus, percent)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (7, "A b c d e f g"), (None, "a b c d e f g"), (9, None), (8, "")]
    found = near_dups.near_duplicates(frame(spark, rows, "doc_id bigint, text string")).collect()
    assert sorted((r["id"] or 0, r["n_shingles"], r["component"]) for r in found if r["id"]) == [
        (5, 3, 5), (5, 3, 5), (7, 3, 5), (8, 0, 8), (9, 0, 9)]
    assert [r["component"] for r in found if r["id"] is None] == [None]
    assert near_dups.near_duplicates(frame(spark, [], SCHEMA)).count() == 0


def test_signature_keys_meet_within_the_distance():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, near_dups.SLOTS)
    for _ in range(300):
        b = a.copy()
        at = rng.choice(near_dups.SLOTS, near_dups.DISTANCE, replace=False)
        b[at] += 1
        errors = [(a[i: i + near_dups.CHUNK] != b[i: i + near_dups.CHUNK]).sum() for i in range(0, near_dups.SLOTS, near_dups.CHUNK)]
        assert min(errors) <= 1


def test_languages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang = "xx" if i % 2 else "yy"
        letters = "abcdef" if lang == "xx" else "defghi"
        text = " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
        rows.append((i, text, lang if i % 5 else None, "s", 1))
    rows += [(1000, None, "xx", "s", 1), (1001, "", "xx", "s", 1), (1002, "12 !!", "xx", "s", 1), (None, "abc abc abc", "xx", "s", 1),
             (1003, "ab " * 700_000, None, None, None)]
    found = language_id.predict_languages(with_clashing(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    right = {i: "xx" if i % 2 else "yy" for i in range(400)}
    assert sum(r["lang_pred"] == right[r["id"]] for r in found if r["id"] is not None and r["id"] < 400) >= 396
    for r in found:
        held = r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 4 == 2
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["id"] in (1000, 1001, 1002))
    nothing = language_id.predict_languages(frame(spark, [(1, "abc", None, "s", 1)])).collect()
    assert nothing[0]["lang_pred"] == "und"
    assert language_id.predict_languages(frame(spark, [], SCHEMA)).count() == 0


def profile_by_hand(text, size):
    counts = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f"_{word}_"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i: i + n]
                if gram != "_":
                    counts[gram] = counts.get(gram, 0) + 1
    return sorted(counts.items(), key=lambda x: -x[1])[:size], counts


def test_ngram_counts_match_plain_python():
    for text in ("Der Hund, der Ünd bellt!", "a", "a b a", "x1y"):
        codes, counts = language_id.ngram_counts(text)
        _, expect = profile_by_hand(text, 300)
        assert sorted(counts.tolist()) == sorted(expect.values())


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        scale = sum(weights[s] for s in order if s not in stopped)
        made = {s: 3 * sizes[s] if s in stopped else rest * weights[s] / scale for s in order}
        more = {s for s in order if made[s] > 3 * sizes[s]}
        if not more:
            return made
        stopped |= more


def test_mixing(spark, corpus):
    df = with_clashing(frame(spark, corpus))
    found = mixing.mix_sources(df).collect()
    sizes = {}
    for doc, text, _, source, _ in corpus:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    expect = targets_by_hand(sizes)
    assert len(found) == len(corpus)
    largest = {}
    taken = {}
    for r in found:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["_h1"] == "kept"
        assert r["target"] == pytest.approx(expect[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for source, target in expect.items():
        assert abs(taken[source] - target) <= largest[source] + 1
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in found}
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns
    assert copies.count() == sum(r["taken"] // r["size"] for r in found if r["size"])
    assert copies.where("size = 'kept'").count() == copies.count()
    assert mixing.mix_sources(frame(spark, [], SCHEMA)).count() == 0


def test_mixing_rates_match_a_bisection(spark, corpus):
    """The dual solved by bisection in plain Python: the copies of every range of sizes are its rates, to less than a copy."""
    import math

    found = mixing.mix_sources(frame(spark, corpus)).collect()
    by_source = {}
    for r in found:
        if r["size"]:
            by_source.setdefault(r["source"], []).append(r)
    targets = targets_by_hand({s: sum(r["size"] for r in own) for s, own in by_source.items()})
    for source, own in by_source.items():
        mean = sum(r["size"] for r in own) / len(own)
        rate = lambda m, size: min(3.0, math.exp(min(m * size / mean, 30.0)))
        low, high = -40.0 * mean, 40.0 * mean
        for _ in range(200):
            middle = (low + high) / 2
            if sum(r["size"] * rate(middle, r["size"]) for r in own) < targets[source]:
                low = middle
            else:
                high = middle
        run = copies = 0.0
        own.sort(key=lambda r: r["size"])
        for i, r in enumerate(own):
            run, copies = run + rate(low, r["size"]), copies + r["copies"]
            if i + 1 == len(own) or own[i + 1]["size"] > r["size"]:
                assert abs(run - copies) < 1.01, (source, r["size"])


def test_mixing_without_words(spark):
    rows = [(1, None, "x", "a", 0), (2, "", "x", None, 0), (3, "w", "x", "b", 1), (3, "w", "x", "b", 1)]
    found = mixing.mix_sources(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["taken"], round(r["target"])) for r in found) == [(1, 0, 0), (2, 0, 0), (3, 1, 2), (3, 1, 2)]


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_round_trip(spark, corpus, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    rows = [*corpus, (300, "odd\x1cspace a b <|endoftext|> x<|startoftext|>y", None, None, 1), (None, "no id", None, None, 1)]
    made = packing.pack(with_clashing(frame(spark, rows).repartition(3)), tokenizer, with_ids=True).collect()
    ids = {doc: plain.encode(text or "", add_special_tokens=False).ids + [2] for doc, text, *_ in rows}
    pieces, sequences = {}, {}
    for r in made:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]][r["start"]: r["start"] + r["length"]]
        assert r["ids"] == own and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
    for doc, own in pieces.items():
        own.sort(key=lambda r: r["start"])
        assert sum((r["ids"] for r in own), []) == ids[doc]
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert len(pieces) == len(ids) and padding <= 0.03 * total
    assert packing.pack(frame(spark, [], SCHEMA), tokenizer).count() == 0


def test_cheapest_cuts_match_brute_force():
    rng = random.Random(2)
    window = 16
    for _ in range(60):
        positions = sorted({0, *(rng.randrange(1, 70) for _ in range(25))})
        positions = [p for i, p in enumerate(positions)]
        if max(b - a for a, b in zip(positions, positions[1:], strict=False)) > window:
            continue
        penalties = [0] + [rng.choice([0, 3, 9]) for _ in positions[1:]]
        best = {0: 0}
        for j in range(1, len(positions)):
            best[j] = min(best[i] + window - (positions[j] - positions[i]) for i in range(j)
                          if positions[j] - positions[i] <= window) + penalties[j]
        cuts = packing.cheapest_cuts(positions, penalties, window)
        cost, before = 0, 0
        for cut in cuts:
            assert cut - before <= window
            cost += window - (cut - before) + penalties[positions.index(cut)]
            before = cut
        assert cost == best[positions.index(cuts[-1])]
        assert positions[-1] - cuts[-1] <= window


def test_powers_of_two():
    assert packing.powers_of_two(4096) == [4096]
    assert packing.powers_of_two(11) == [8, 10, 11]


def test_quality(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        pool = [f"w{rng.randrange(300)}" for _ in range(40)]
        docs.append((i, " ".join(pool) + "." if good else " | ".join(pool), "xx", "s", 1))
        labels.append((i, int(good), 0))
    docs += [(9000, None, None, None, None), (9001, "", "xx", "s", 0), (None, "w1 w2", "xx", "s", 0), (9002, "w1 " * 200_000, "x", "s", 0)]
    labels += [(9001, None, None), (None, 1, 0), (1, 1, 0), (77777, 0, 0)]
    table = frame(spark, labels, "doc_id bigint, quality int, toxic int")
    found = quality.classify(with_clashing(frame(spark, docs)), table).collect()
    assert len(found) == len(docs)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    blank = quality.classify(frame(spark, docs), table.limit(0)).collect()
    assert {r["score"] for r in blank} == {0.5}
    assert quality.classify(frame(spark, [], SCHEMA), table).count() == 0


def test_query_digest_is_of_utf8(spark, corpus):
    assert hashlib.sha256("é".encode()).hexdigest() == spark.range(1).select(F.sha2(F.lit("é").cast("binary"), 256)).first()[0]


def test_quality_sample_bounds_the_rows(spark):
    """A sampled id that repeats in the documents is one training row."""
    docs = spark.createDataFrame([(1, "a b")] * 300 + [(1, "c d")] + [(i, f"t{i}") for i in range(2, 20)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id int, quality int")
    drawn = quality.training_sample(docs, labels, "doc_id", "text", "quality", 1000)
    assert drawn.count() == 19


def test_other_tokenizer_files_are_taken_as_they_are(tmp_path):
    """A file that splits or normalises in another way gives the tokenizer's own ids, not those of the short cut."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.Encoder(path).by_words
    with open(path) as source:
        changed = json.load(source)
    changed["normalizer"]["normalizers"] = changed["normalizer"]["normalizers"][:2]  # upper case stays
    (tmp_path / "other.json").write_text(json.dumps(changed))
    encoder = packing.Encoder(str(tmp_path / "other.json"))
    text = "Some Words, HERE and 12 there!\nÉté it's"
    assert not encoder.by_words
    assert encoder.ids(text).tolist() == Tokenizer.from_file(str(tmp_path / "other.json")).encode(text, add_special_tokens=False).ids
    assert encoder.ids("").tolist() == []


def test_languages_match_plain_out_of_place_distances(spark):
    """Profiles, distances and scores by hand, ties included (texts of a few letters)."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcde"[k: k + 4]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))),
             f"l{k}", "s", 1) for i in range(240) for k in (i % 2,)]
    code = lambda gram: sum((1 if c == "_" else ord(c)) << 21 * (len(gram) - 1 - n) for n, c in enumerate(gram))
    ranked = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:300]
    profiles = {}
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for gram, n in profile_by_hand(text, 300)[1].items():
                held = profiles.setdefault(lang, {})
                held[gram] = held.get(gram, 0) + n
    places = {lang: {g: r for r, g in enumerate(ranked(counts))} for lang, counts in profiles.items()}
    found = {r["id"]: r for r in language_id.predict_languages(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        own = ranked(profile_by_hand(text, 300)[1])
        apart = {lang: sum(abs(p[g] - r) if g in p else 300 for r, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(apart), key=apart.get)
        assert found[i]["lang_pred"] == best and abs(found[i]["score"] - (1 - apart[best] / (300 * len(own)))) < 1e-12
