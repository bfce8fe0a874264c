import random
import textwrap

from larkspur.llm.license_scan import TEMPLATES, Scanner, differences, license_scan, located, regions_of, words_of

from .conftest import words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_differences():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        missing, extra, changed = differences(a, b)
        assert missing + extra + changed == distance(a, b) and extra - missing == len(a) - len(b)


def test_every_template_is_its_own_best():
    scan = Scanner(TEMPLATES, 0.25)
    for name, text in TEMPLATES.items():
        (found,) = scan.instances(words_of(text))
        assert found[2] == name and not any(found[4:]), name


def test_located_is_the_nearest_stretch():
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.choice("abc") for _ in range(r.randint(0, 12))], [r.choice("abc") for _ in range(r.randint(1, 5))]
        s, e, missing, extra, changed = located(a, b)
        assert missing + extra + changed == distance(a[s:e], b) == min(distance(a[i:j], b) for i in range(len(a) + 1) for j in range(i, len(a) + 1))


def test_neighbouring_and_embedded_notices(documents):
    """Notices line by line, several on one line, and within prose."""
    rows = [
        (1, "Released under the MIT License.\n" + TEMPLATES["CC-BY-4.0"]),
        (2, "My great parser for toy grammars, by Jane Doe and friends. Released under the MIT License."),
        (3, "some prose\n" + TEMPLATES["MPL-2.0"] + " " + TEMPLATES["Apache-2.0"] + " and then more prose on " + TEMPLATES["Unlicense"]),
        (4, TEMPLATES["MIT-text"] + "\n" + TEMPLATES["MIT-text"]),
    ]
    found = sorted((x.doc_id, x.block_line, x.license, x.exact) for x in license_scan(documents(rows)).collect())
    assert found == [
        (1, 0, "MIT", True), (1, 1, "CC-BY-4.0", True), (2, 0, "MIT", True),
        (3, 1, "Apache-2.0", True), (3, 1, "MPL-2.0", True), (3, 1, "Unlicense", True), (4, 0, "MIT-text", True), (4, 1, "MIT-text", True),
    ]


def test_recall_over_all_templates(documents):
    """Every template, in every kind of surroundings, exact and with a word in ten edited."""
    r, rows, want = random.Random(5), [], {}
    for name, text in sorted(TEMPLATES.items()):
        for edit in (False, True):
            w = text.split()
            if edit:
                for at in range(7, len(w), 10):
                    w[at] = "thing"
            for before, after in (("", ""), ("prose here ", " and there"), ("a line\n\n", "\n\nof prose"), ("under copyright of nobody\n", "\nall warranty is void")):
                want[len(rows)] = name
                rows.append((len(rows), before + " ".join(w) + after))
    found: dict = {}
    for x in license_scan(documents(rows)).collect():
        found.setdefault(x.doc_id, set()).add(x.license)
    assert sum(want[d] in found.get(d, ()) for d in want) >= 0.99 * len(want)


def test_found_in_texts(documents, edges):
    r = random.Random(2)
    rows, want = [], {}
    names = sorted(TEMPLATES)
    for i in range(60):
        lines = [" ".join(words(r, 12)) for _ in range(r.randint(0, 6))]
        if i % 2:
            name = names[i % len(names)]
            at = r.randint(0, len(lines))
            text = TEMPLATES[name]
            want[i] = (name, at, True)
            if len(text) > 300:
                text = text.replace("permit", "allow").replace("terms", "rules")
                want[i] = (name, at, text == TEMPLATES[name])
            lines[at:at] = [text]
        rows.append((i, "\n".join(lines)))
    rows += [(1000 + (i or 0), t) for i, t, *_ in edges] + [(5000, "a licence for fishing is needed here"), (5001, "copyright is a matter of law in most places of the world")]
    found = license_scan(documents(rows)).collect()
    assert {x.doc_id: (x.license, x.block_line, x.exact) for x in found} == want and len(found) == len(want)


def test_blocks_and_nothing(documents):
    vocabulary = {"license", "the", "mit", "under"}
    assert regions_of("x y z\nunder the MIT license\n\nthe license\na b\nthe mit", vocabulary) == [(["under", "the", "mit", "license", "the", "license"], [1, 1, 1, 1, 3, 3])]
    assert regions_of(None, vocabulary) == [] and license_scan(documents([])).count() == 0


#: Words at which notices start a new paragraph in their published layout.
PARAGRAPHS = {
    "MIT-text": ["The above copyright notice", "THE SOFTWARE IS PROVIDED"],
    "Apache-2.0-header": ["You may obtain", "Unless required"],
    "GPL-3.0-header": ["This program is distributed", "You should have received"],
    "BSD-2-Clause": ["1. Redistributions", "2. Redistributions", "THIS SOFTWARE IS PROVIDED"],
    "ISC": ["THE SOFTWARE IS PROVIDED"],
    "MPL-2.0": [],
}


def test_published_layouts(documents):
    """Blank and comment-only lines within a notice, wrapped lines, and prose, a title and a copyright line around it."""
    rows, want, r = [], {}, random.Random(3)
    for name, starts in PARAGRAPHS.items():
        text = TEMPLATES[name]
        for at in starts:
            assert at in text
            text = text.replace(at, "\n\n" + at, 1)
        lines = []
        for paragraph in text.split("\n\n"):
            lines += [textwrap.fill(paragraph.strip(), 72, break_long_words=False, break_on_hyphens=False), ""]
        notice = "\n".join(lines[:-1])
        for mark in ("", "# ", " * ", "// "):
            head = ["Some Program", "", "Copyright (c) 2019 Somebody Else", ""]
            body = [*head, *notice.split("\n"), "", " ".join(words(r, 12))]
            doc = len(rows)
            want[doc] = (name, 4, notice.count("\n") + 1, True)
            rows.append((doc, "\n".join((mark + x).rstrip() for x in body)))
    found = license_scan(documents(rows)).collect()
    assert {x.doc_id: (x.license, x.block_line, x.n_lines, x.exact) for x in found} == want and len(found) == len(want)
