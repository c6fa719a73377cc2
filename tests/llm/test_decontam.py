"""The whole method against a plain search, re-parameterised items, and windows that everyone shares."""

import random

import numpy as np
import pytest

from nebulark.llm import decontam

SF = "/root/testdata/sf0.001"
WORDS = "train leaves station sells boxes apples farmer walks river bridge counts sheep paints wall builds fence carries bags pours water reads pages runs track climbs hill bakes bread cuts rope fills tank plants trees drives road".split()


def grams(templates, text, item):
    """{position: hashes with their slots}, and the number of positions, of one text."""
    h, counts, kind, ids, folded, folded_counts, folded_kind = templates.windows(text)
    other = folded_counts & (folded != h)
    total = int(counts.sum())
    if item and total:
        other &= counts
    elif item:
        total = int(folded_counts.sum())
    out = [(i, int(h[i]), tuple(templates.slots(i, kind, ids))) for i in np.flatnonzero(counts)]
    out += [(i, int(folded[i]), tuple(templates.slots(i, folded_kind, ids))) for i in np.flatnonzero(other)]
    return out, total


def plain_contaminated(docs, items, coverage=decontam.COVERAGE):
    """Every document with every item, diagonal by diagonal; items without windows are left to other tests."""
    templates, found = decontam.Templates(), {}
    known = {k: grams(templates, t, True) for k, t in items.items()}
    for i, text in docs.items():
        seen = {}
        for pos, h, slots in grams(templates, text, False)[0]:
            seen.setdefault(h, []).append((pos, slots))
        for k, (windows, total) in known.items():
            diagonals = {}
            for at, h, slots in windows:
                for pos, other in seen.get(h, ()):
                    places, pairs = diagonals.setdefault(pos - at, (set(), set()))
                    places.add(at)
                    pairs.update(zip(slots, other, strict=True))
            good = [(p, any(a != b for a, b in s)) for p, s in diagonals.values() if len({a for a, _ in s}) == len(s)]
            hit = set().union(*[p for p, _ in good])
            if total and len(hit) >= coverage * total:
                found[i, k] = (len(hit) / total, all(c for _, c in good))
    return found


def problem(r, k):
    """A word problem and a second one with other numbers, names and units in the same places."""
    first, second = ("Alice", "Springfield", "km", "Bob"), ("Maria", "Shelbyville", "miles", "Tom")
    body = [r.choice(WORDS) for _ in range(r.randint(24, 40))]
    numbers = [str(r.randint(2, 900)) for _ in range(3)]
    places = sorted(r.sample(range(3, len(body)), 7))
    kinds = ["n", "who", "where", "n", "unit", "n", "whom"]
    r.shuffle(kinds)

    def fill(names, figures):
        out, figures = list(body), iter(figures)
        for at, kind in zip(places, kinds, strict=True):
            out[at] = next(figures) if kind == "n" else dict(zip(("who", "where", "unit", "whom"), names, strict=True))[kind]
        return f"Problem where {' '.join(out)} so how many remain for item {k}"

    return fill(first, numbers), fill(second, [str(int(n) + r.randint(1, 50)) for n in numbers])


def test_found_rows_equal_a_plain_search(spark):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {b.item_id: b.text for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    r = random.Random(8)
    for k in range(25):
        item, other = problem(r, k)
        items[1000 + k] = item
        words = item.split()
        docs |= {10_000 + 10 * k: f"words before\n{item}\nwords behind", 10_001 + 10 * k: other, 10_002 + 10 * k: item.upper(), 10_003 + 10 * k: " ".join(words[: len(words) // 2]), 10_004 + 10 * k: " ".join(words[: r.randint(8, len(words))]) + " and " + other}
    frame = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.coverage, x.changed) for x in decontam.contaminated(frame, bench).collect()}
    want = plain_contaminated(docs, items)
    assert got.keys() == want.keys() and len(want) > 75
    for pair, (coverage, changed) in want.items():
        assert got[pair] == (pytest.approx(coverage), changed), pair


def test_re_parameterised_items_are_recalled(spark):
    r = random.Random(21)
    pairs = [problem(r, k) for k in range(120)]
    filler = lambda: " ".join(r.choice(WORDS) for _ in range(60))
    docs = [(k, f"{filler()}\n{changed}\n{filler()}") for k, (_, changed) in enumerate(pairs)] + [(1000 + k, filler() + ". " + filler()) for k in range(200)]
    bench = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(pairs)], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert all(x.doc_id == x.item_id for x in got)
    assert sum(x.changed for x in got) >= 0.9 * len(pairs)


def test_windows_that_all_share_bring_no_pairs_forward(spark, monkeypatch):
    opening = "what is the total number of items that remain when"
    r = random.Random(3)
    tails = [" ".join(r.choice(WORDS) for _ in range(14)) for _ in range(60)]
    bench = spark.createDataFrame([(k, f"{opening} {t}") for k, t in enumerate(tails)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{opening} {t}") for k, t in enumerate(tails)] + [(100 + k, f"{opening} nothing else happens here today at all") for k in range(500)], "doc_id long, text string")
    sizes, write = {}, decontam.materialize

    def counted(df, name, *rest):
        out = write(df, name, *rest)
        sizes[name] = out
        return out

    monkeypatch.setattr(decontam, "materialize", counted)
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()}
    assert got == {(k, k) for k in range(60)}
    shared = {x.hash for x in sizes["benchmark-met"].where("often > 500").collect()}
    assert shared and not shared & {x.hash for x in sizes["benchmark-probes"].collect()}


def test_items_of_one_id_and_other_types(spark):
    one, two = "the old miller counts seven brown sheep near his quiet pond", "a young baker sells nine warm loaves behind the church today"
    bench = spark.createDataFrame([("a", one), ("a", two), ("a", two), ("b", two)], "item_id string, text string")
    docs = spark.createDataFrame([(1, one), (2, two), (3, "nothing")], "doc_id int, text string")
    got = sorted((x.doc_id, x.item_id, x.coverage) for x in decontam.contaminated(docs, bench).collect())
    assert got == [(1, "a", 1.0), (2, "a", 1.0), (2, "b", 1.0)]


def test_other_numbers_and_units_in_words(spark):
    """Re-parameterised copies whose numbers are spelled out and whose units have other forms than the item's."""
    items = [
        (1, "A train covers 60 km in 2 hours along the coast. How far does it travel at this speed in 5 hours of steady driving?"),
        (2, "The baker mixes 3 kg of flour with 500 ml of water for each tray. How much flour does she need for 12 trays?"),
        (3, "A pump fills a tank of 900 liters in 45 minutes. How many liters does the pump move in one and a half hours?"),
        (4, "Two boxes weigh 14 pounds together and one is 4 pounds heavier than the other. How heavy is the lighter box?"),
    ]
    copies = [
        (10, "A train covers 85 kilometers in three hours along the coast. How far does it travel at this speed in seven hours of steady driving?", 1),
        (11, "a train covers ninety kilometres in 3 h along the coast. how far does it travel at this speed in 8 h of steady driving?", 1),
        (20, "The baker mixes seven kilograms of flour with 250 milliliters of water for each tray. How much flour does she need for twenty trays?", 2),
        (30, "A pump fills a tank of 1200 gallons in thirty seconds. How many gallons does the pump move in one and a half days?", 3),
        (40, "Two boxes weigh eighteen kilograms together and one is six kilograms heavier than the other. How heavy is the lighter box?", 4),
    ]
    clean = [(90, "Two old boats and three small dogs went to the coast for seven days of rest."), (91, "The baker sells ten loaves and walks home in an hour.")]
    docs = spark.createDataFrame([(i, f"Some words before it.\n{t}\nAnd after it.") for i, t, _ in copies] + clean, "doc_id long, text string")
    got = {(x.doc_id, x.item_id, x.changed) for x in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, item, True) for i, _, item in copies}
