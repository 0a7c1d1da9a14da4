"""Toxicity, personal data and license scans."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from inkwell.llm import licenses, pii, toxicity
from tests.llm.conftest import EDGES

FORMATS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    spans = []
    for k, (name, p) in enumerate(FORMATS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if good:
                spans.append((m.start(), k, m.end()))
    return ",".join(f"{FORMATS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_formats(docs):
    rng = random.Random(2)
    bits = ["a@b.c", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+12", "@", "word", "é", "0001.2.3.4", "a@b.c@d.e", "..", "+1+2345678901", "j.d@mail.example.com.", "5"]
    rows = [*EDGES, *((100 + i, rng.choice(["", " "]).join(rng.choices(bits, k=rng.randint(0, 9)))) for i in range(200))]
    want = sorted((str(d), hashlib.sha256(base(t).encode()).hexdigest(), *(base(t).count(f"{n}:") for n, _ in FORMATS)) for d, t in rows)
    found = pii.personal_data(docs(rows)).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in found) == want
    assert pii.personal_data(docs([])).count() == 0


def test_patterns_find_unseen_formats(docs):
    """'member phone' leads to phones only, so what stands there in another format is one too; 'part' does not."""
    rows = [(i, f"the member phone +1 555 010 {1000 + i} is listed") for i in range(60)] + [(100 + i, f"use part {1000 + i}-77 here") for i in range(60)]
    rows += [(200, "the member phone 555-0199-22 is listed"), (201, "use part 555-0199-22 here"), (202, None)]
    found = {r["doc_id"]: r for r in pii.personal_data(docs(rows)).collect()}
    assert found[200]["spans"] == "phone:17:28" and found[200]["n_phone"] == 0 and found[200]["n_found"] == 1
    assert found[201]["spans"] == "" and sum(r["n_found"] for r in found.values()) == 1
    texts = {r["doc_id"]: r["text"] for r in pii.redact(docs(rows)).collect()}
    assert texts[200] == "the member phone [PHONE] is listed" and texts[201] == "use part 555-0199-22 here" and texts[202] is None
    assert texts[0] == "the member phone [PHONE] is listed" and len(texts) == len(rows)


def test_patterns_find_identifiers_with_spaces(docs):
    """Spaced and bracketed identifiers are found whole, each by the words around all of it."""
    cards = [f"4{i:014}" for i in range(1000, 1040)]
    cards = [next(c + d for d in "0123456789" if luhn(c + d)) for c in cards]
    rows = [(i, f"the member phone +1 555 010 {1000 + i} is listed") for i in range(60)] + [(100 + i, f"paid from account {c} today") for i, c in enumerate(cards)]
    phones = ("020 7946 0958", "07700 900123", "(743) 555-3824", "020 - 7946 - 0958", "(0)20 7946 0958")
    accounts = ("DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "FR14 2004 1010 0505 0001 3M02 606")
    rows += [(200 + i, f"the member phone {x} is listed") for i, x in enumerate(phones)] + [(300 + i, f"paid from account {x} today") for i, x in enumerate(accounts)]
    rows += [(401, "the member phone 07700 900123. 20 boats"), (402, "the member phone 07700 900123\n44 55 66"), (403, "use part 020 7946 0958 here")]
    rows += [(404, "the member phone 07700 900123 " + "12345 67890 " * 50)]
    found = {r["doc_id"]: r for r in pii.personal_data(docs(rows)).collect()}
    for i, x in enumerate(phones):
        assert found[200 + i]["spans"] == f"phone:17:{17 + len(x)}", x
    for i, x in enumerate(accounts):
        assert found[300 + i]["spans"] == f"card:18:{18 + len(x)}", x
    texts = {r["doc_id"]: r["text"] for r in pii.redact(docs(rows)).collect()}
    assert texts[201] == texts[202] == "the member phone [PHONE] is listed"
    assert [texts[d] for d in (401, 402, 403)] == ["the member phone [PHONE]. 20 boats", "the member phone [PHONE]\n44 55 66", "use part 020 7946 0958 here"]
    assert "07700" not in texts[404] and "900123" not in texts[404]


def test_candidates_are_whole():
    def found(text):
        return [x[2] for x in pii._candidates(text, pii.base_spans(text))]

    assert found("phone=(743) 555-3824, (020 7946 0958) or a@b.c 07700 900123\n44556") == ["a@b.c", "(743) 555-3824", "020 7946 0958", "07700 900123", "44556"]
    assert found("use 12345-67 and item 99 a1b2c3d4e5f6 10.0.0.1 77777") == ["10.0.0.1", "12345-67", "a1b2c3d4e5f6", "77777"]
    text = "1 22 333 " * 2_000
    assert "".join(found(text)).replace(" ", "") == text.replace(" ", "") and max(map(len, found(text))) < 2 * pii.LONGEST


def test_contexts_have_whole_words():
    long = "x" * 5_000
    text = f"first {long} {'y' * 300} a@b.c {'z' * 700} end"
    a = text.index("a@b.c")
    assert pii._before(text, a) == [long, "y" * 300] and pii._after(text, a + 5) == ["z" * 700]
    assert pii._before("one a@b.c", 4) == ["one"] and pii._before("a@b.c", 0) == [] and pii._after("a@b.c", 5) == []
    assert pii._before("q " + " " * 500 + "w ", 504) == ["q", "w"] and pii._after("x" + " " * 500, 1) == []
    assert pii._contexts(text, a, a + 5) != pii._contexts(text.replace("y" * 300, "y" * 299), a - 1, a + 4)
    assert all(len(p) <= pii.LONG_PATTERN for p in pii._contexts(text, a, a + 5))


def test_redact_keeps_rows(docs):
    rows = [*EDGES, (8, "a@b.c"), (8, "a@b.c"), (8, "b@c.d and a@b.c"), (None, "1.2.3.4")]
    found = pii.redact(docs(rows))
    assert found.columns == docs(rows).columns
    fixed = {"a@b.c": "[EMAIL]", "b@c.d and a@b.c": "[EMAIL] and [EMAIL]", "1.2.3.4": "[IP]"}
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted(((d, fixed.get(t, t)) for d, t in rows), key=str)


def test_licenses(docs):
    rows = [*EDGES, *((100 + i, f"Some text before.\n{t}\nSome text after.") for i, (_, t) in enumerate(licenses.TEMPLATES))]
    rows += [(200, "It was licensed as a driver by the state of Ohio."), (201, "Licensed under CC BY-NC 4.0. All rights reserved."), (202, "LICENSED UNDER THE MIT LICENSE."), (203, "Licensed under the Apache License, Version 1.1.")]
    found = {r["doc_id"]: r for r in licenses.license_scan(docs(rows)).collect()}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert name in found[100 + i]["licenses"].split(","), (name, found[100 + i])
    assert found[200]["licenses"] == "" and found[202]["licenses"] == "MIT" and found[203]["licenses"] == ""
    assert found[201]["licenses"] == "CC-BY-NC-4.0,Proprietary" and found[201]["n_grants"] == 2
    assert all(found[d]["n_grants"] == 0 for d, _ in EDGES)
    assert licenses.license_scan(docs([])).count() == 0


def test_compression_ranks_the_right_template_first():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES:
        assert name in {n for _, _, n, _ in scanner.scan(text)}


PROSE = "The members met in the hall near the harbour, and after a long talk about boats, weather and the price of fish they agreed on a plan for the year. "


def test_grants_within_prose_and_over_lines():
    """Every template in the middle of a paragraph, and hard-wrapped with a comment sign, is found in its place."""
    scanner = licenses.Scanner()
    for name, grant in licenses.TEMPLATES:
        text = PROSE + grant + " " + PROSE
        assert [x[:3] for x in scanner.scan(text)] == [(len(PROSE), len(PROSE) + len(grant.rstrip(".")), name)], grant
        for wrapped in (textwrap.fill(text, 40), textwrap.fill(grant, 18), textwrap.fill(text, 60, subsequent_indent=" # ")):
            assert [n for _, _, n, _ in scanner.scan(wrapped)] == [name], wrapped
    notice = "Copyright 2021 Harbour Society of Eastport and contributors. Licensed under the MIT License. All rights reserved."
    assert [n for _, _, n, _ in scanner.scan(notice)] == ["MIT", "Proprietary"]
    assert scanner.scan(PROSE + "The boat was licensed by the state, with permission of the owner. " + PROSE) == []


def test_every_grant_of_a_line():
    """Several grants beside each other, lookalikes among them, and one that is repeated."""
    scanner = licenses.Scanner()

    def names(text):
        return [n for _, _, n, _ in scanner.scan(text)]

    assert names("All rights reserved. Licensed under the Apache License, Version 2.0.") == ["Proprietary", "Apache-2.0"]
    assert names("Licensed under the MIT License. Licensed under CC BY 4.0. All rights reserved.") == ["MIT", "CC-BY-4.0", "Proprietary"]
    assert names("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert names("Licensed under the MIT License. " * 5) == ["MIT"] * 5
    grants = sorted(licenses.TEMPLATES * 2, key=lambda t: zlib.crc32(t[1].encode()))
    assert names(" ".join(t for _, t in grants if t != licenses._BSD)) == [n for n, t in grants if t != licenses._BSD]


def exact_grants(text):
    """Brute force: every template laid on every word of a text, the longest first, where all words are equal."""
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:[.-][^\W_]+)*", text)]
    words = [text[a:b].lower() for a, b in places]
    out, free = [], [True] * len(words)
    for name, t in sorted(licenses.TEMPLATES, key=lambda t: -len(t[1])):
        want = [w.lower() for w in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", t)]
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want and all(free[i : i + len(want)]):
                free[i : i + len(want)] = [False] * len(want)
                out.append((places[i][0], places[i + len(want) - 1][1], name))
    return sorted(out)


def test_grants_against_brute_force(docs):
    """Random mixtures of prose, grants and near misses."""
    rng = random.Random(13)
    misses = ["Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU General Public License, version 4.", "a licensed pilot", "with permission", "the public domain"]
    rows = []
    for d in range(150):
        parts = [rng.choice([PROSE, PROSE, *misses, *(t for _, t in licenses.TEMPLATES)]) for _ in range(rng.randint(1, 9))]
        rows.append((d, rng.choice([" ", "\n"]).join(parts)))
    want = {d: ",".join(f"{n}:{a}:{b}" for a, b, n in exact_grants(t)) for d, t in rows}
    assert {r["doc_id"]: r["spans"] for r in licenses.license_scan(docs(rows)).collect()} == want


def test_notices_as_they_stand_in_files():
    notices = {
        "MIT": licenses._MIT + licenses._MIT_BODY, "ISC": licenses._ISC + licenses._ISC_BODY, "Apache-2.0": licenses._APACHE + licenses._APACHE_BODY,
        "GPL-2.0": "This program is free software; " + licenses._GNU.format("General Public", "2"), "LGPL-2.1": "This library is free software; " + licenses._GNU.format("Lesser General Public", "2.1"),
        "BSD-3-Clause": f"{licenses._BSD}: {licenses._BSD_CONDITIONS} {licenses._BSD_NAMES}",
    }
    scanner = licenses.Scanner()
    for name, notice in notices.items():
        for width in (70, 78, 100):
            for sign in ("", "# ", " * ", "// "):
                text = "Copyright (c) 2020 Somebody\n\n" + textwrap.fill(notice, width, initial_indent=sign, subsequent_indent=sign) + "\n\nint main() {}\n"
                assert [n for _, _, n, _ in scanner.scan(text)] == [name], (name, width, sign)
    assert [n for _, _, n, _ in scanner.scan("Licensed under the MIT License. Later also: Licensed under the MIT License.")] == ["MIT", "MIT"]


def test_bsd_by_its_conditions():
    two = f"""{licenses._BSD}:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    three = two + """
3. Neither the name of Eastport Society nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
"""
    advert = "\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Eastport Society.\n"
    end = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".'
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (two + advert + three[len(two) :].replace("3.", "4."), "BSD-4-Clause"), (f"{licenses._BSD}: none.", "LicenseRef-BSD")):
        assert [n for _, _, n, _ in licenses.Scanner().scan(PROSE + text + end)] == [name]


def labelled(n=600):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        t = rng.choices(words, k=40)
        if toxic:
            for _ in range(3):
                t[rng.randrange(40)] = "zqvx" + "".join(rng.choices("klmno", k=3)) if i % 16 else rng.choice(("moron", "idiot"))
        rows.append((i, " ".join(t)))
        if i % 4 != 3:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs):
    rows, labels = labelled()
    table = spark.createDataFrame([*labels, (5, None), (7, 3), (None, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs([*rows, *((10_000 + (d or 0), t) for d, t in EDGES)]), table).collect()
    assert len(found) == len(rows) + len(EDGES)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 10_000]
    hits = [r["predicted"] for r in held if r["doc_id"] % 8 == 0]
    false = [r["predicted"] for r in held if r["doc_id"] % 8]
    assert sum(hits) >= 0.9 * len(hits) and sum(false) <= 0.02 * len(false)


def vote_table(n=400):
    """Rows of votes: voter 1 mostly repeats voter 0, voter 2 is on its own, voter 3 never fires."""
    rng = random.Random(17)
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        a = rng.random() < (0.7 if toxic else 0.1)
        b = rng.random() < (0.95 if a else 0.02)
        c = rng.random() < (0.5 if toxic else 0.05)
        rows.append([v for v, x in enumerate((a, b, c)) if x])
    return rows


def test_label_model_against_brute_force(spark):
    """Expectation maximisation row by row, with posteriors multiplied out, for the forest of one edge that these votes have."""
    rows, start, prior, quiet = vote_table(), {0: 0.6, 1: 0.55, 2: 0.7, 3: 0.9}, 0.2, 0.05
    found = spark.createDataFrame([([*r, 7],) for r in rows], "found array<int>")
    model = toxicity.label_model(found, [0, 1, 2, 3], start, prior, quiet)
    assert model.parent == {1: 0} and set(model.alone) == {0, 1, 2}
    fired = {v: sum(v in r for r in rows) for v in (0, 1, 2)}
    rate = {(v, y, m): fired[v] * (start[v] if y else 1 - start[v]) / (prior if y else 1 - prior) / len(rows) for v in fired for y in (0, 1) for m in (0, 1)}

    def posterior(r):
        if not r:
            return quiet
        like = [1 - prior, prior]
        for y in (0, 1):
            for v in r:
                like[y] *= rate[v, y, int(v == 1 and 0 in r)]
        return like[1] / sum(like)

    keep = 1 - toxicity.ANCHOR
    for _ in range(toxicity.ROUNDS):
        p = [posterior(r) for r in rows]
        size = [len(rows) - sum(p), sum(p)]
        new = {}
        for v in fired:
            e = keep * sum(x for x, r in zip(p, rows, strict=True) if v in r) + (1 - keep) * fired[v] * start[v]
            for m in (0, 1):
                new[v, 1, m], new[v, 0, m] = e / size[1], (fired[v] - e) / size[0]
        met = [x for x, r in zip(p, rows, strict=True) if 0 in r and 1 in r]
        toxic = len(met) * (keep * sum(met) / len(met) + (1 - keep) * max(start[0], start[1]))
        for y, n in ((1, toxic), (0, len(met) - toxic)):
            ours, up = new[1, y, 0] * size[y], new[0, y, 0] * size[y]
            n, weight = min(n, ours, up), toxicity.PRIOR_ROWS * ours / size[y]
            new[1, y, 1], new[1, y, 0] = (n + weight) / (up + toxicity.PRIOR_ROWS), (ours - n + weight) / (size[y] - up + toxicity.PRIOR_ROWS)
        done = max(abs(math.log(new[k] / rate[k])) for k in rate) < 1e-3 and _ > 0
        rate = new
        if done:
            break
    patterns = sorted({tuple(r) for r in rows})
    table = spark.createDataFrame([(list(r),) for r in patterns], "votes array<int>")
    for r in table.withColumn("odds", model.odds(F.col("votes"))).collect():
        assert abs(1 / (1 + math.exp(-r["odds"])) - posterior(r["votes"])) < 1e-9
    # The copying voter adds little to the voter that it repeats.
    assert model.alone[0] + model.alone[1] + model.both[1] - max(model.alone[0], model.alone[1]) < 0.5 * min(model.alone[0], model.alone[1])
    assert toxicity.label_model(found.limit(0), [0, 1], start, prior, quiet).alone == {}


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs([(1, "you are a moron and an idiot"), (2, "a pleasant day"), (3, None)]), none).collect()}
    assert found[1] > found[2] and found[2] == found[3]
    assert toxicity.toxicity_scores(docs([]), none).count() == 0


def test_long_runs_of_capitals():
    """Texts of one run of capitals take linear time."""
    finder = toxicity._Finder([])
    assert finder.find("A" * 1_000_000) == []
    assert finder.find("x" + "LOUD, " * 4) == finder.find("LOUD WORDS 1 MORE !NOISE") == [finder.first_pattern]


@pytest.mark.parametrize(
    "text,want",
    [
        ("This file is not licensed under the MIT License.", ""), ("It isn't released under the MIT License", ""), ("Not all rights reserved.", ""), ("never was Licensed under CC BY 4.0.", ""),
        ("This is not it. Licensed under the MIT License.", "MIT"), ("Not long ago this was, by its authors, licensed under the MIT License.", "MIT"),
        ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("SPDX-License-Identifier: none", ""),
        ("Use of the SPDX-License-Identifier: tag", ""),
    ],
)
def test_denials_and_tags(text, want):
    assert ",".join(n for _, _, n, _ in licenses.Scanner().scan(text)) == want
