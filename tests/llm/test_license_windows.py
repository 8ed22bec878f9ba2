"""Licences of several lines and paragraphs inside longer texts, against all runs of lines."""

import random
import re
import time

import pytest

from lexspark.llm import license_scan, license_windows
from lexspark.llm.common import table
from tests.conftest import SF

OTHER = "\n".join(" ".join(f"word{k}x{j}" for j in range(10)) for k in range(20))


def laid_out(template, width, blank):
    """The template in lines of ``width`` words, a blank line after every ``blank``-th line if given."""
    w = template.split()
    lines = [" ".join(w[i : i + width]) for i in range(0, len(w), width)]
    return "\n".join(x + "\n" * bool(blank and i % blank == blank - 1) for i, x in enumerate(lines))


def brute(text):
    lines = [w for x in (text or "").lower().split("\n") if (w := re.findall(r"[^\W_]+", x))]
    best = {}
    for name, t in license_scan.TEMPLATES.items():
        want = set(license_scan._bigrams(t))
        for i in range(len(lines)):
            seen, last = set(), None
            for line in lines[i:]:
                row = line if last is None else [last, *line]
                seen |= {f"{a} {b}" for a, b in zip(row, row[1:])}
                last = line[-1]
                if len(seen) > 1.5 * len(want) + 1:
                    break
                if seen:
                    best[name] = max(best.get(name, 0), 2 * len(seen & want) / (len(seen) + len(want)))
    hits = {n: d for n, d in best.items() if d >= license_scan.MIN_DICE}
    top = min(((-d, n) for n, d in hits.items()), default=(None, None))
    return ";".join(sorted(hits)), top[1], None if top[0] is None else round(-top[0], 6)


@pytest.mark.parametrize("blank", [0, 2])
def test_each_template_is_found_in_a_longer_text(spark, blank):
    names = list(license_scan.TEMPLATES)
    rows = [(i, f"{OTHER}\n{laid_out(license_scan.TEMPLATES[n], 9, blank)}\ndef main():\n{OTHER}") for i, n in enumerate(names)]
    got = {r["doc_id"]: r["licenses"] for r in license_windows.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [n for i, n in enumerate(names) if n not in got[i]] == []


def test_windows_equal_brute_force(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(-1, None), (-2, ""), (-3, "one"), (-4, "\n \n"), (-5, f"{laid_out(mit, 3, 4)}\n{laid_out(mit, 5, 0)}"), (-6, "Released\nunder\n\nthe MIT\nLicense\nReleased under the MIT License"), (-7, f"{OTHER} {mit[:300]}\n{mit[300:]}")]
    rows += [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id int, text string").selectExpr("*", "1 AS licenses")
    got = {r["doc_id"]: (";".join(r["licenses"]), r["best_license"], r["best_dice"] and round(r["best_dice"], 6)) for r in license_windows.scan(docs).collect()}
    assert [(t, got[i], brute(t)) for i, (_, t) in enumerate(rows) if got[i] != brute(t)] == []
    assert license_windows.scan(docs.limit(0)).count() == 0 and license_windows.scan(docs, {}).where("size(licenses) > 0").count() == 0


def test_lines_that_come_again_equal_brute_force(spark):
    rng, lines = random.Random(5), laid_out(license_scan.TEMPLATES["MIT"], 7, 0).split("\n")
    odd = ["the", "software", "the software", "software the software", "other words here", "of the software"]
    texts = ["\n".join(lines * 3), "\n".join(rng.choices(lines, k=60)), "\n".join(lines + lines[::-1] + lines[3:])]
    for _ in range(12):
        at = rng.randrange(len(lines))
        mixed = lines[:at] + rng.choices(odd + lines[:4], k=rng.randrange(1, 12)) + lines[at:]
        texts.append("\n".join(mixed * rng.randrange(1, 4)))
    short = license_scan.TEMPLATES["MIT"].split()
    texts += ["\n".join(rng.choices(short, k=120)) for _ in range(3)]
    got = {r["doc_id"]: (";".join(r["licenses"]), r["best_license"], r["best_dice"] and round(r["best_dice"], 6)) for r in license_windows.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != brute(t)] == [] and sum(bool(g[0]) for g in got.values()) > 5


def test_a_licence_of_5000_lines_takes_seconds(spark):
    lines = laid_out(license_scan.TEMPLATES["MIT"], 9, 0).split("\n")
    text = "\n".join((lines * (5_000 // len(lines) + 1))[:5_000])
    begin = time.perf_counter()
    row = license_windows.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert "MIT" in row["licenses"] and row["best_dice"] == 1.0 and time.perf_counter() - begin < 60
