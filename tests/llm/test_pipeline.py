"""Each stage of the pipeline on the smallest data, against plain Python on that stage's own input."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_documents import components_by_hand, lines_by_hand, targets_by_hand, words  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, written and reread as the driver does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 !!", "en", "src1", 8), (10**6 + 2, "", "en", "src1", 0)],
                                  docs.schema)
    docs = docs.unionByName(extra)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA)
        made.write.parquet(str(folder / name))
        made = spark.read.parquet(str(folder / name))
        found[name] = (docs.collect(), made.collect(), docs.columns, made.columns)
        docs = made
    return found


def test_stage_names_and_columns(stages):
    assert list(stages) == ["language_id", "line_dedup", "minhash_near_dedup", "mixing", "packing"]
    for name, (_, _, before, after) in stages.items():
        assert name == "packing" or after == before


def test_language_stage_keeps_what_has_letters(stages):
    before, after, _, _ = stages["language_id"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if r["text"] and any(c.isalpha() for c in r["text"])}
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_stage_without_profiles_keeps_what_has_letters(spark, lang):
    """No label at all, or labels of letterless texts only: nothing can be learned."""
    texts = {1: "one two", 2: "12 34 !!", 3: None, 4: "", 5: "\u00e9", 6: "1 " * 600_000 + "z"}
    docs = spark.createDataFrame([(i, t, lang if i == 2 else None, "s", None) for i, t in texts.items()],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.keep_known_languages(spark, docs, DATA)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == {i: texts[i] for i in (1, 5, 6)}


def test_line_stage(stages):
    before, after, _, _ = stages["line_dedup"]
    expect = lines_by_hand([tuple(r) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == {d: text for d, (_, _, text) in expect.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_stage(stages):
    before, after, _, _ = stages["minhash_near_dedup"]
    expect = components_by_hand([tuple(r) for r in before], 80)
    assert {r["doc_id"] for r in after} == {d for d, (_, component) in expect.items() if d == component}


def test_mixing_stage(stages):
    before, after, _, _ = stages["mixing"]
    sizes, largest, taken = {}, {}, {}
    for r in before:
        size = len(words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + size
        largest[r["source"]] = max(largest.get(r["source"], 0), size)
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    for source, target in targets_by_hand(sizes).items():
        assert abs(taken.get(source, 0) - target) <= largest[source] + 1
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3


def test_packing_stage(stages):
    before, after, _, _ = stages["packing"]
    wanted = Counter(r["doc_id"] for r in before)
    held, totals = Counter(), {}
    for r in after:
        held[r["doc_id"]] += r["length"]
        totals[r["doc_id"]] = r["doc_tokens"]
        assert len(r["ids"]) == r["length"]
    assert held == Counter({d: n * totals[d] for d, n in wanted.items()})
    by_sequence = Counter()
    for r in after:
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) <= 4096


LONG = " ".join(f"word{i % 997} a{i}" for i in range(10_000))
CLASHES = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, lang_pred string, " \
          "n_lines string, n_dropped string, _copy string, id string, size string, component string, c0 string, _row string"


def odd_rows():
    """Repeated rows, ties, null ids, ids with several texts, nulls in every column and a text of 20,000 words."""
    near = " ".join(f"n{i}" for i in range(60))
    texts = [(1, "Alpha beta gamma delta epsilon zeta eta theta."), (2, near + " end"), (3, near + " other"), (4, LONG), (5, LONG + " tail"),
             (6, "A line that repeats itself\nown line of six here"), (7, "A line that repeats itself\nown line of seven here"),
             (8, "one text of eight that is alone"), (8, "another text under the very same id of eight"), (9, None), (10, ""), (11, "x")]
    rows = [(i, t, "en", f"s{i % 2}", len(t) if t else None) for i, t in texts]
    rows += [(12, "a third of all rows are this one row, again and again", "en", "s0", 53)] * 12
    rows += [(None, "no id but a text of its own words", "en", "s1", 33), (None, near + " none", None, None, None), (None, None, None, None, None)]
    return [(*r, *[f"own {c}" for c in "abcdefghij"]) for r in rows]


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "minhash_near_dedup", "mixing"])
def test_stages_keep_every_column(spark, name):
    docs = spark.createDataFrame(odd_rows(), CLASHES)
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, docs, DATA)
    assert made.schema.simpleString() == docs.schema.simpleString()
    before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in made.collect()]
    assert {r[5:] for r in after} == {before[0][5:]}
    texts = Counter((r[0], r[1]) for r in after)
    if name == "language_id":
        assert Counter(after) == Counter(r for r in before if r[1])
    elif name == "line_dedup":
        expect = Counter(r[0] for r in before)
        assert Counter(r[0] for r in after) == expect
        assert texts[7, "own line of seven here"] == 1 and texts[6, "A line that repeats itself\nown line of six here"] == 1
        assert texts[12, odd_rows()[12][1]] == 12  # one document keeps its own lines
        assert all(r[4] == len(r[1]) for r in after if r[0] == 7)
    elif name == "minhash_near_dedup":
        assert len(after) == len(set(after)) and texts[12, odd_rows()[12][1]] == 1
        assert {r[0] for r in after} == {1, 2, 4, 6, 7, 8, 9, 10, 11, 12, None}
        assert sum(r[0] == 8 for r in after) == 2 and sum(r[0] is None for r in after) == 2  # near 2: gone
    else:
        assert set(after) <= set(before) and max((Counter(after) - Counter(before * 3)).values(), default=0) == 0
        assert texts[12, odd_rows()[12][1]] > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, name):
    docs = spark.createDataFrame([], CLASHES)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, DATA).count() == 0


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), CLASHES)
    made = corpus_pipeline.pack_sequences(spark, docs, DATA).collect()
    held = Counter()
    for r in made:
        held[r["doc_id"]] += r["length"]
    assert sum(r["start"] == 0 for r in made) == len(odd_rows()) and held[12] % 12 == 0 and held[9] == 1


def test_mixing_of_equal_rows_is_spread(spark):
    """A third of all rows are equal: they are counted, and no window holds them."""
    from chainlens.llm import mixing

    rows = [(i, f"w {i} " * (i % 9 + 1), "s0") for i in range(4000)] + [(5, "the same words in each", "s0")] * 2000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)
    held = []
    real = mixing._without
    mixing._without = lambda parts, hot: held.append((real(parts, hot).collect(), hot.collect())) or real(parts, hot)
    try:
        mixed = mixing.mix_sources(docs).groupBy("doc_id", "text").agg({"*": "count", "taken": "sum"}).collect()
    finally:
        mixing._without = real
    parts, hot = held[0]
    assert [h["copies"] for h in hot] == [2000]
    assert max(p["n"] for p in parts if p["part"] <= 256) < 200
    assert sum(r["count(1)"] for r in mixed) == 6000
    sizes = {r: len(words(r[1])) for r in rows}
    assert abs(sum(r["sum(taken)"] for r in mixed) - sum(sizes[r] for r in rows)) <= max(sizes.values())
