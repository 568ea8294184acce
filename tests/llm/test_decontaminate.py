from strandloom.llm import decontaminate as d

from .helpers import corpus, docs
from .test_repeats import thue_morse

ITEMS = "item_id bigint, text string, doc_id string"


def items():
    texts = [r[1] for r in corpus()]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    return [(1, cut(texts[10], 5, 30), "z"), (2, texts[3].upper(), "z"), (11, "W1 w2", "z"), (12, None, "z"), (13, "...", "z"), (14, "w5", "z"), (15, "x x x x x x x x x", None), (16, cut(texts[10], 2, 14), "z"), (17, cut(texts[10], 2, 14), "z")]


def test_report_matches_brute_force(spark):
    rows = corpus()
    got = d.digest_columns(d.contamination(docs(spark), spark.createDataFrame(items(), ITEMS))).collect()
    want = d.brute_force([r[:2] for r in rows], [i[:2] for i in items()])
    assert sorted(tuple(r)[:-1] for r in got) == sorted(want) and all(r.n_near >= r.n_items for r in got)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def uncontaminated(rows, items, window=8):
    """ids of the rows without a whole window and with fewer than two items, by plain scanning."""
    reports = d.brute_force(rows, items), d.brute_force(rows, [(i, t) for i, t in items if len(d.brute_words(t)) >= window])
    return {r[0] for r, whole in zip(*reports, strict=True) if r[3] < 2 and not whole[3]}


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    rows = corpus()
    good = uncontaminated([r[:2] for r in rows], [i[:2] for i in items()])
    kept = d.decontaminate(docs(spark), spark.createDataFrame(items(), ITEMS)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr(r) for r in rows if r[0] in good)
    assert 0 < len(kept) < len(rows)


def test_one_passage_drops_a_document_and_one_short_item_does_not(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "the end"), (3, "of it")], "item_id bigint, text string")
    rows = [(1, "so b c d e f g h i yes"), (2, "b c d e f g h no"), (3, "the end the end the end"), (4, "the end of it"), (5, None), (6, "")]
    kept = d.decontaminate(spark.createDataFrame(rows, "doc_id bigint, text string"), bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 5, 6}


def test_matches_and_proximity_over_a_stored_index(spark):
    data = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c x d e f g h"), (3, None), (None, "a b c d e f g h")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "A b c d e f g h")], "item_id bigint, text string")
    index = d.stored_index(data)
    assert {tuple(r) for r in d.phrase_matches(index, bench).collect()} == {(1, 7, 0, 8), (None, 7, 0, 8)}
    near = {(r.doc_id, r.start) for r in d.phrase_matches(index, bench, slop=1).collect()}
    assert {(1, 0), (2, 0), (None, 0)} <= near


def test_blocks_and_empty_tables(spark, monkeypatch):
    rows = corpus()
    bench = spark.createDataFrame(items(), ITEMS)
    monkeypatch.setattr(d.phrase_blocks, "__defaults__", (d.WINDOW, "text", "item_id", 50))
    assert sorted(tuple(r)[:-1] for r in d.digest_columns(d.contamination(docs(spark), bench)).collect()) == sorted(d.brute_force([r[:2] for r in rows], [i[:2] for i in items()]))
    assert d.contamination(docs(spark, []), bench).count() == 0
    assert d.contamination(docs(spark), bench.limit(0)).where("n_items > 0").count() == 0


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse()
    seven = "a b c d e f g"
    rows = [(1, f"{seven} {one} x"), (2, f"{seven} {two} x")]
    bench = [(1, f"{seven} {one}"), (2, one)]
    got = d.digest_columns(d.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")))
    assert sorted(tuple(r)[:-1] for r in got.collect()) == d.brute_force(rows, bench)


def near_items(texts, items, window=8, slop=1):
    """By text, the items with a window whose words all occur within `slop` places of where its rarest word puts them.

    Rarest in the shard, so the texts are those of one shard."""
    import collections

    texts = [d.brute_words(t) for t in texts]
    often = collections.Counter(w for t in texts for w in t)
    out = []
    for t in texts:
        found = set()
        for item, raw in items:
            w = d.brute_words(raw)
            n = min(window, len(w))
            for k in range(max(1, len(w) - window + 1) if w else 0):
                run = w[k : k + n]
                rare = min(range(n), key=lambda i: (often[run[i]], i))
                for at in (i for i, x in enumerate(t) if x == run[rare]):
                    s = at - rare
                    if s >= 0 and s + n <= len(t) and all(run[i] in t[max(s + i - slop, 0) : s + i + slop + 1] for i in range(n) if i != rare):
                        found.add(item)
        out.append(len(found))
    return out


def test_proximity_matches_brute_force(spark):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(30)]
    items = []
    for i in range(20):
        w = r.choice([t for t in texts if len(t.split()) > 12]).split()
        k = r.randrange(len(w) - 10)
        cut = w[k : k + 10]
        if i % 2:
            j = r.randrange(9)
            cut[j], cut[j + 1] = cut[j + 1], cut[j]
        items.append((i, " ".join(cut)))
    rows = list(enumerate(texts))
    got = d.contamination(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert [len(x.near) for x in sorted(got)] == near_items(texts, items)
    assert sum(len(x.near) > x.n_items for x in got) > 5 and sorted((x.doc_id, x.n_words, x.n_hit, x.n_items) for x in got) == [w[:4] for w in d.brute_force(rows, items)]
