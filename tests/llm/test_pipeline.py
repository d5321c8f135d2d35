"""Each stage of the pipeline against a plain version, on its own input."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as cp  # noqa: E402

from ruleframe.llm import common, decontaminate as dc, line_dedup as ld, near_dup as nd, packing as pk, toxicity as tx  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def outputs(spark):
    """What each stage returns; the first entry is the input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"input": docs}
    for name, stage in cp.STAGES:
        out[name] = docs = common.stored(stage(spark, docs, DATA), "stage")
    return out


def by_id(df):
    rows = df.collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]


def test_columns_stay(outputs):
    for name in ("toxicity", "line dedup", "near dedup", "decontamination"):
        assert outputs[name].columns == outputs["input"].columns


def test_toxic_rows_go(spark, outputs):
    scored = by_id(tx.toxicity_scores(outputs["input"], spark.read.parquet(f"{DATA}/labels.parquet")))
    kept = by_id(outputs["toxicity"])
    assert kept.keys() == {i for i, r in scored.items() if not r.predicted} and len(kept) < len(scored)
    assert all(kept[i] == r for i, r in by_id(outputs["input"]).items() if i in kept)


def test_repeated_lines_go(outputs):
    before, after = by_id(outputs["toxicity"]), by_id(outputs["line dedup"])
    count = Counter(k for r in before.values() for k in {ld.line_key(x) for x in ld.lines_of(r.text)} if k)
    assert before.keys() == after.keys()
    for i, r in before.items():
        want = b"\n".join(x for x in ld.lines_of(r.text) if count[ld.line_key(x)] < cp.REPEATED_LINE_DOCUMENTS).decode()
        assert after[i].text == want and after[i].n_chars == len(want)


def test_one_of_each_group_stays(outputs):
    rows = sorted((i, set(nd.shingle_set(r.text).tolist())) for i, r in by_id(outputs["line dedup"]).items())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            if x and y and 100 * len(x & y) >= cp.NEAR_PERCENT * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    assert by_id(outputs["near dedup"]).keys() == {i for i, _ in rows if find(i) == i}


def test_benchmark_passages_go(spark, outputs):
    items = [dc.words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, after = by_id(outputs["near dedup"]), by_id(outputs["decontamination"])

    def holds(words):
        for item in items:
            budget, row = int(len(item) * dc.ERROR_RATE + 1e-9), [0] * (len(words) + 1)
            if len({*item} & {*words}) < len({*item}) - budget:
                continue
            for i, a in enumerate(item, 1):
                nxt = [i]
                for j, b in enumerate(words, 1):
                    nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (a != b)))
                row = nxt
            if item and min(row) <= budget:
                return True
        return False

    assert after.keys() == {i for i, r in before.items() if not holds(dc.words_of(r.text))}
    assert len(after) < len(before)


def test_every_word_is_packed(outputs):
    texts, packed = by_id(outputs["decontamination"]), outputs["packing"].collect()
    words = Counter()
    for r in packed:
        words[r.doc_id] += r.units
    assert words == Counter({i: len(nd.words_of(r.text)) for i, r in texts.items()}) and set(words) == set(texts)
    bins = {}
    for r in packed:
        bins.setdefault((r.bin_id, r.bin_capacity, r.bin_used), []).append((r.bin_offset, r.units + pk.SEPARATOR))
    for (_, capacity, used), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == used <= capacity


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table pass all stages."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "no id"), (None, None), (6, long), (7, long), (8, "a\n" * 30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    documents = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    labels = spark.createDataFrame([(4, 1, None), (None, 0, 1), (6, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "never there at all")], "item_id long, text string")
    for n, docs in enumerate((documents, documents.where("false"))):
        folder = str(tmp_path / str(n))
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        got = cp.run(spark, folder).collect()
        if n:
            assert got == []
        else:
            # Of the copies (4, 5 and 6, 7) the least id stays; all others do, with or without id.
            assert Counter(r.doc_id for r in got if r.piece == 0) == Counter([1, 2, 3, 4, 6, 8, None, None])


def test_what_was_stored_can_be_released(spark):
    a, b = common.stored(spark.range(3), "a"), common.stored(spark.range(4), "b")
    kept = [p for p in common._written[spark.sparkContext.applicationId] if p != a.stored_path]
    common.discard(a)
    assert not Path(a.stored_path.removeprefix("file://")).exists() and b.count() == 4
    assert common._written[spark.sparkContext.applicationId] == kept
