"""License scans against a plain search."""

import re

from edge import documents, texts
from joeira.llm.licenses import NOTICES, PHRASES, scan_licenses, words_of


def plain(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns(spark):
    out = scan_licenses(documents(spark))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((i, *plain(t)) for i, t in texts()), key=str)
    assert scan_licenses(documents(spark).limit(0)).count() == 0


def test_labels_of_the_method(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "licensed under the very same apache license version 2 0"),  # words put in: a neighbouring diagonal
        (3, "under the"),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "license license license the mit"),
    ]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].labels == "apache,apache-2.0" and got[1].score == 1.0
    assert "apache" in got[2].labels and got[2].n_base == 1
    assert got[3].labels == "" and 0 < got[3].score < 0.5
    assert got[4].labels == "cc-by,cc-by-nc-4.0"
    assert got[5].labels == "" and got[5].n_base == 0


def test_notices_are_told_apart(spark):
    wanted = {
        "this work is licensed under the gnu general public license version 2": "gpl,gpl-2.0",
        "this work is licensed under the gnu general public license version 3": "gpl,gpl-3.0",
        "You may use it under the GNU General Public License v3.": "gpl,gpl-3.0",
        "this work is licensed under the gnu general public license": "gpl",
        "licensed under the apache license v2 0": "apache,apache-2.0",
        "licensed under the apache license version 1 0": "apache",
        "released under the terms of the mit license": "mit,mit-notice",
        "licensed under cc by 4.0": "cc-by,cc-by-4.0",
        "licensed under cc by-sa 4.0": "cc-by,cc-by-sa-4.0",
        "subject to the terms of the mozilla public license": "",
        "redistribution of the source in any form": "",
    }
    rows = list(enumerate(wanted))
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i] for i, _ in rows] == list(wanted.values())


def test_one_word_replaced_put_in_or_missing(spark):
    rows, wanted = [], {}
    for notice, (label, *own) in NOTICES.items():
        words = notice.split()
        # Words that tell the notice from its like have to stand.
        free = [k for k, w in enumerate(words) if not any(w in pair.split() for pair in own)]
        if label == "mit-notice":
            free = [0]  # of five words, another one lost leaves too little
        for k in free:
            for changed in (words[:k] + ["zz"] + words[k + 1 :], words[:k] + words[k + 1 :], words[: k + 1] + ["zz"] + words[k + 1 :]):
                if label in ("cc-by-4.0", "apache-2.0", "mit-notice") and len(changed) < len(words) and k > 0:
                    continue
                wanted[len(rows)] = label
                rows.append((len(rows), " ".join(["before", *changed, "after"])))
    got = {r.doc_id: r.labels.split(",") for r in scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    versions = {label for label, *_ in NOTICES.values()}
    wrong = {rows[i][1]: got[i] for i, label in wanted.items() if [x for x in got[i] if x in versions] != [label]}
    assert not wrong


def test_words_do_not_reach_across_texts_of_a_chunk(spark):
    rows = [(1, "mit"), (2, "license"), (3, "MIT\tLicense")]
    got = {r.doc_id: r.n_base for r in scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_equal_words_have_equal_hashes():
    _, _, h = words_of("ab ab abc é ab é".encode())
    assert h[0] == h[1] == h[4] and h[3] == h[5] and len(set(h.tolist())) == 3
