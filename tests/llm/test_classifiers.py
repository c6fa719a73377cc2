import numpy as np
import pandas as pd

from nebulark.llm import decontam, langid, license_scan, toxicity
from nebulark.llm.queries import op5_toxicity, op6_language, op8_decontaminate, op9_license_scan

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    got = op5_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(x.predicted and not x.toxic for x in got) <= 1
    caught = [x.predicted for x in got if x.toxic]
    assert sum(caught) >= 0.5 * len(caught)


def test_toxicity_edge_cases_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 3 == 0 else "kind words ") * 5, 1.0) for i in range(90)] + [(None, "you idiot", 0.0), (5, "repeated idiot", 0.0), (1000, None, 0.0), (1001, "", 0.0), (1002, "calm " * 200_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (3, None), (3, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 95 and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.predicted for x in got if x.doc_id != 5}
    assert by[0] == 1 and by[1] == 0 and by[None] == 1 and by[1000] == by[1001] == by[1002] == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if not x.predicted}
    none = toxicity.train(docs, labels.limit(0))
    assert {x.predicted for x in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_identity_terms_are_evened_out():
    kept = np.arange(3)  # insult, term, other term
    data = pd.DataFrame({"toxic": [1, 1, 1, 0, 0, 0], "f": [[0, 1], [0, 1], [1], [2], [2], []], "swaps": [[[1, -1, 2]], [[1, -1, 2]], [[1, -1, 2]], [[2, -1, 1]], [[2, -1, 1]], []]})
    biased = toxicity._fit(kept, data, 0.0, 1e-3, 400).weights
    fair = toxicity._fit(kept, data, 50.0, 1e-3, 400).weights
    assert biased[1] - biased[2] > 1 and abs(fair[1] - fair[2]) < 0.2 < fair[0]


def test_language_on_held_out_rows(spark):
    got = op6_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) >= 0.98


def test_language_edge_cases(spark):
    filters = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "123 !! \n"), (None, "le la les et une avec"), (4, "a"), (4, "a"), (5, "the and of that " * 60_000), (6, "漢字" * 5)]
    got = langid.identify(spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, lang string"), filters).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.lang_pred for x in got}
    assert by[1] == by[2] == by[3] == "und" and by[None] == "fr" and by[5] == "en" and by[6] in filters.langs
    empty = langid.train(spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    assert empty.predict(["text"])[0] == ["und"]
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), filters).count() == 0


def test_more_languages_than_bits_in_a_word(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, i: letters[k % 26] + letters[k // 26] + letters[(k + i) % 26] + letters[(3 * k + i) % 26] + letters[k % 26]
    text = lambda k, at: " ".join(word(k, i) for i in range(at, at + 24))
    rows = [(100 * k + j, text(k, j), f"l{k:02d}") for k in range(70) for j in range(4)]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.table.shape == (1 << langid.SLOT_BITS, 2)
    got = langid.identify(spark.createDataFrame([(k, text(k, 7)) for k in range(70)], "doc_id long, text string"), filters).collect()
    assert sum(x.lang_pred == f"l{x.doc_id:02d}" for x in got) >= 68


def test_sliced_filter_equals_plain_sets():
    grams = {0: langid.ngram_hashes(langid._clean("alpha beta gamma")), 1: langid.ngram_hashes(langid._clean("beta delta"))}
    table = np.zeros((1 << langid.SLOT_BITS, 1), np.uint64)
    for k, h in grams.items():
        for s in langid._slots(h):
            table[s, 0] |= np.uint64(1 << k)
    f = langid.Filters(["x", "y"], table, np.zeros(2), 0)
    text = "beta alpha"
    h = langid.ngram_hashes(langid._clean(text)).tolist()
    assert f.shares([text, ""]).tolist() == [[sum(g in set(grams[k].tolist()) for g in h) for k in (0, 1)], [0, 0]]


def test_benchmark_passages_found_and_no_others(spark):
    docs = {d.doc_id: " ".join(d.text.split()) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {b.item_id: " ".join(b.text.split()) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    exact = {(i, k) for i, t in docs.items() for k, b in items.items() if b in t}
    found = {(x.doc_id, x.item_id) for x in op8_decontaminate(spark, SF).collect()}
    assert exact <= found
    for i, k in found - exact:  # near: most of the item's words in order
        have = set(zip(*(docs[i].split()[j:] for j in range(3)), strict=False))
        want = list(zip(*(items[k].split()[j:] for j in range(3)), strict=False))
        assert sum(w in have for w in want) >= 0.5 * len(want)


def test_templates_and_slots(spark):
    item = "Alice has 12 apples and gives 5 apples to Bob so how many apples out of 12 does Alice have left"
    changed = "Maria has 30 apples and gives 7 apples to Tom so how many apples out of 30 does Maria have left"
    mixed = changed.replace("out of 30", "out of 99")  # the same slot with two values
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "two words", 0), (None, item, 0), (4, "1 2 3 4 5 6 7", 0)], "item_id long, text string, coverage int")
    filler = "some other words that say nothing here "
    docs = spark.createDataFrame(
        [(1, filler + "\n" + item, ""), (2, filler + "\n" + changed + " " + filler * 3, ""), (3, mixed, ""), (4, None, ""), (5, "", ""), (6, filler * 50_000, ""), (None, item, ""), (7, "9 8 7 6 5 4 3 2 1 two words", ""), (8, item, ""), (8, item, "")],
        "doc_id long, text string, item_id string",
    )
    got = {(x.doc_id, x.item_id): x.changed for x in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (8, 1): False}
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["3", "4", "5", "6", "7", "None"]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


LINES = ("Which Planet has eight small moons and rings", "Seen by Every child before winter comes around", "While the Old miller counts his seven sheep", "Then say how Many stones lie there tonight")


def test_indented_quoted_and_bulleted_copies(spark):
    item = "\n".join(LINES)
    forms = ["\n    ", "\n> ", "\n>> - ", "\n* ", '\n" ', " .\n\n \t-- "]
    docs = spark.createDataFrame([(i, "words" + "".join(f + x for x in LINES) + "\n--") for i, f in enumerate(forms)], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {x.doc_id: (x.coverage, x.changed) for x in got} == {i: (1.0, False) for i in range(len(forms))}
    kinds = decontam.Templates().windows("a b\nlast Name Which\n--")[2].tolist()
    assert kinds == [0, 0, 0, 2, 2]  # a lone mark behind the last word opens nothing


def test_copies_in_other_case(spark):
    item = "Alice has 12 apples and gives 5 apples to Bob so how many apples out of 12 does Alice have left"
    towns = "The Train from Springfield to Ogdenville takes 3 hours while the Bus from Shelbyville needs 5 hours so which town is nearer"
    forms = [str.lower, str.upper, str.title, str.swapcase, str]
    rows = [(f"{k} {i}", "words here\n" + f(x)) for i, x in enumerate((item, towns)) for k, f in enumerate(forms)]
    rows += [("renamed 0", item.replace("Alice", "Maria").replace("Bob", "Tom").lower())]
    heads = "Greatest Rivers Of Northern Lands Beyond Windy Mountains"
    rows += [("5 2", heads), ("6 2", heads.lower())]
    bench = spark.createDataFrame([(0, item), (1, towns), (2, heads)], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id string, text string"), bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == sorted((k, int(k[-1])) for k, _ in rows)
    assert all(x.coverage == 1 and x.changed == x.doc_id.startswith("renamed") for x in got), got


def test_items_without_windows_match_exactly(spark):
    items = {1: "12 + 7 + 30 = 49 or 5 10 15 20", 2: "Alice, Bob, Maria, Tom, 3 km, 5 km", 3: "Name four rivers", 4: "1 2 3 4 5 6 7", 5: "Why not?", 6: "..."}
    docs = [(10 * i + k, f(x)) for i, x in items.items() if i < 5 for k, f in enumerate([str, lambda x: "some words\n> " + x.lower() + " more words"])]
    docs += [(50, "so\n- why not\nnow"), (61, "and why not go"), (62, "7 6 5 4 3 2 1 0"), (63, "name four other rivers ..."), (64, "1 2 3 4 5 6 8 7"), (65, "so why\nnot")]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((x.doc_id, x.item_id, x.coverage, x.changed) for x in got) == [(i, i // 10, 1.0, False) for i, _ in docs if i < 60]


def test_rows_of_one_id_and_rows_without_id(spark, tmp_path):
    from corpus_pipeline import STAGES

    item = "the old miller counts seven brown sheep near his quiet pond and then sells every single one again"
    words = item.split()
    rows = [(1, item), (1, "a clean row of the same id"), (2, " ".join(words[:7])), (2, " ".join(words[7:14])), (None, item), (None, "clean"), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {(x.doc_id, x.item_id) for x in op8_decontaminate(spark, str(tmp_path)).collect()} == {(1, 1), (None, 1)}
    kept = dict(STAGES)["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[1] != item)
    nameless = spark.createDataFrame([(None, item), (None, "another item of some seven words here")], "item_id long, text string")
    found = decontam.contaminated(docs, nameless).collect()
    assert sorted((str(x.doc_id), x.item_id) for x in found) == [("1", None), ("None", None)]
    assert sorted(str(x.doc_id) for x in decontam.drop_contaminated(docs, nameless).collect()) == ["1", "2", "2", "3", "None"]


def test_licences_found_and_no_others(spark):
    marks = {"GPL": "GNU General Public License, version 3", "CC-BY-NC": "CC BY-NC 4.0", "MIT": "under the MIT License", "Apache-2.0": "Apache License, Version 2.0"}
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: sorted(f for f, m in marks.items() if m in t) for i, t in docs.items()}
    assert {x.doc_id: x.families for x in op9_license_scan(spark, SF).collect()} == want


def test_licence_edge_cases(spark):
    model = license_scan.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, None), (2, "\n \n"), (None, "Released under the MIT License."), (3, "words " * 100_000 + "\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (4, "The MIT students released a balloon"), (4, "my driver's license")]
    got = license_scan.scan(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, family string"), model).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == 6 and by[1].n_paragraphs == by[2].n_paragraphs == 0 and by[None].family == "MIT"
    assert by[3].families == ["CC-BY-NC", "MIT"] and by[3].n_licences == 2
    assert all(x.family == "unknown" and x.score == 0 for x in got if x.doc_id == 4)
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert license_scan.train(spark.createDataFrame([], "text string")).judge("Released under the MIT License.")[0] == "MIT"


def test_wrapped_notices_of_every_family(spark):
    model = license_scan.train(spark.read.parquet(f"{SF}/documents.parquet"))
    prose = "The river runs down to the sea.\nOld boats lie on the shore."
    texts = []
    for family, templates in license_scan.TEMPLATES.items():
        for words in map(str.split, templates):
            for mark in ("", "# ", " * "):
                texts += [(family, f"{prose}\n{mark}{' '.join(words[:k])}\n{mark}{' '.join(words[k:])}\n{prose}") for k in range(1, len(words))]
                texts += [(family, f"{prose}\n\n" + "\n".join(mark + " ".join(words[k : k + 4]) for k in range(0, len(words), 4)))]
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string"), model).collect()}
    assert [(t, got[i].families) for i, (f, t) in enumerate(texts) if got[i].families != [f] or got[i].n_licences != 1] == []


def test_cut_and_edited_notices_are_recalled_and_prose_is_not(spark):
    import random

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = license_scan.train(docs)
    r = random.Random(41)
    plain = [w for x in docs.where("lang = 'en'").limit(30).collect() for w in x.text.split() if w.isalpha() and w.islower()]
    texts = []
    for family, templates in license_scan.TEMPLATES.items():
        for words in (t.split() for t in templates if len(t.split()) >= 8):
            for _ in range(12):
                cut = words[: len(words) - r.randint(0, len(words) // 5)]
                edited = [r.choice(plain) if r.random() < 0.05 else w for w in cut]
                at = r.randint(1, len(edited) - 1)
                texts.append((family, f"{' '.join(r.choices(plain, k=40))}\n{' '.join(edited[:at])}\n  {' '.join(edited[at:])}\n{' '.join(r.choices(plain, k=40))}"))
    texts += [(None, " ".join(r.choices(plain + ["license", "free", "software", "rights", "public"], k=120))) for _ in range(200)]
    got = {x.doc_id: x.families for x in license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string"), model).collect()}
    hits = [f in got[i] for i, (f, _) in enumerate(texts) if f]
    assert sum(hits) >= 0.9 * len(hits)
    assert not any(got[i] for i, (f, _) in enumerate(texts) if f is None)


#: Notices in the words that projects use, none of them a template.
NOTICES = {
    "LGPL": (
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this package; if not, see <https://example.org/licenses/>.",
    ),
    "AGPL": (
        "This file is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3, as published by the Free Software Foundation.",
        "Our server is licensed under the GNU Affero General Public License version 3 or later.",
    ),
    "GPL": (
        "This package is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this file.  If not, write to us.",
    ),
    "BSD": (
        "1. Redistributions of source code must retain the copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above notice, this list of\n   conditions and the following disclaimer in the documentation.",
        "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without prior permission.",
        "THIS SOFTWARE IS PROVIDED BY THE AUTHOR AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "MIT": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT.',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files (the Software), to deal in it without restriction",
    ),
    "CC-BY": ("This article is licensed under a Creative Commons Attribution 3.0 License.", "Content is licensed under CC BY 2.0."),
    "CC-BY-SA": ("The text is available under the Creative Commons Attribution-ShareAlike 4.0 License; more terms may apply.", "Images: licensed under CC BY-SA 2.5."),
    "CC-BY-NC": ("These slides are licensed under a Creative Commons Attribution-NonCommercial 4.0 License.",),
    "Apache-2.0": ("This module is licensed under the Apache License, Version 2.0 (see LICENSE).",),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",),
    "BSL-1.0": ("// Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of this software and accompanying documentation covered by this license"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event shall the author be held liable for any damages arising from its use.",),
    "WTFPL": ("This is licensed under the Do What The Fuck You Want To Public License.",),
    "ISC": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that",),
}
#: Terms of no family that is known here.
OTHERS = (
    "Licensed under the European Union Public Licence.",
    "This file is licensed under the Artistic License 2.0 as our distribution asks.",
    "Use of this service is subject to the terms of the agreement that you signed with the provider.",
    "You may redistribute this poem to your friends under the terms that your teacher sets.",
    "The library is free for all students; software is lent for any purpose at no fee.",
    "Creative people at common tables give attribution to each other.",
)


def test_notices_in_other_words_and_terms_of_no_known_family(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = license_scan.train(docs)
    texts = [(f, t) for f, ts in NOTICES.items() for t in ts] + [(None, t) for t in OTHERS]
    prose = "The river runs down to the sea while old boats lie on the shore.\n"
    rows = [(i, prose + t + "\n" + prose) for i, (_, t) in enumerate(texts)]
    got = {x.doc_id: x.families for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    wrong = [(f, got[i], t) for i, (f, t) in enumerate(texts) if got[i] != ([f] if f else [])]
    named = [(f, got[i]) for i, (f, _) in enumerate(texts) if got[i]]
    assert sum(f in g for f, g in named if f) >= 0.9 * sum(f is not None for f, _ in texts), wrong
    assert sum(g == [f] for f, g in named) >= 0.9 * len(named), wrong


def test_notices_of_every_template_inside_one_long_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = license_scan.train(docs)
    filler = " ".join(x.text for x in docs.where("lang = 'en'").limit(40).collect()).split()
    filler = [w for w in filler if w.isalpha() and w.islower()]
    filler = (filler * (20_000 // len(filler) + 1))[:20_000]
    notices = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    texts = [" ".join([*filler[:at], t, *filler[at:]]) for at in (0, 7_000, 20_000) for _, t in notices]
    texts.append(" ".join(t for _, t in notices))  # one behind the other
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (f, t) in enumerate(notices * 3):
        alone = model.judge(t)
        assert got[i].families == [f] == [alone[0]] and got[i].n_licences == 1, t
    assert got[len(texts) - 1].families == sorted(license_scan.TEMPLATES)


def test_unknown_class_is_taught_from_whole_texts(spark):
    late = "permission to redistribute the following public work under this software"
    rows = [(i, "\n" * 60 + "plain words " * 300 + f"{late} {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    fit = license_scan._fit
    license_scan._fit = lambda model, x, y, steps: (seen.extend(x), fit(model, x, y, steps))
    try:
        license_scan.train(docs, steps=1)
    finally:
        license_scan._fit = fit
    assert sum(set(late.split()) <= set(w) for w in seen) > 100
