"""The battery's rule on strings that its reference distributions were not made from."""

import random
import re
import sysconfig
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tabulon.llm import secret_scan as S
from tabulon.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rule():
    return S.least_bits(0.01)


@pytest.mark.parametrize("length", [16, 20, 24, 32, 48, 96])
def test_plain_uniform_keys(rule, length):
    """Keys as they are drawn, with digits or without."""
    rng = random.Random(length + 1)
    for name, alphabet in {**S.ENCODINGS, **S.LETTERS}.items():
        keys = ["".join(rng.choices(alphabet, k=length)) for _ in range(300)]
        found = sum(S.is_random(s, rule) for s in (k.strip("-_/") for k in keys) if len(s) >= S.BANDS[0] and re.search("[A-Za-z]", s))
        assert found >= (0.85 if length < 20 else 0.9) * len(keys), name


def test_bounds_differ_by_band_and_rise(rule):
    for digits in (True, False):
        bounds = [rule.bounds[digits, band] for band in range(len(S.BANDS))]
        assert len(set(bounds)) == len(S.BANDS) and min(bounds) > 0 and bounds[-1] > bounds[0]
    assert S.least_bits(0.01) == rule and S.least_bits(0.2).bounds[True, 0] <= rule.bounds[True, 0]


def test_names_of_other_programs_are_no_secrets(rule):
    """Identifiers, paths and words in Python's own library: hashes and base64 blocks among them are random, so a few pass."""
    found = set()
    for path in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py")):
        text = path.read_text(errors="ignore")
        found |= {text[a:b] for a, b in S.candidates(text, S.base_spans(text))}
    assert len(found) > 1500
    assert sum(S.is_random(s, rule) for s in found) <= 0.03 * len(found)


def test_every_test_of_the_battery_tells_something():
    rng = random.Random(1)
    drawn = [S.random_string(rng, S.ENCODINGS["base62"], 32, True) for _ in range(400)]
    decoys = [S.decoy(rng, S.WORDS[1::2], 32) for _ in range(400)]
    for true, false in zip(zip(*map(S.battery, drawn)), zip(*map(S.battery, decoys))):
        assert all(0 <= p <= 1 for p in (*true, *false))
        # Random strings seldom have small p-values; decoys as often or more.
        assert sum(p < 0.01 for p in true) <= 0.06 * 400 <= 24 and sum(p < 0.05 for p in false) >= sum(p < 0.05 for p in true) - 12


def test_the_query_adds_what_the_rule_accepts(spark, rule):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    want = Counter()
    for doc, text in rows:
        base = S.base_spans(text)
        added = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            s = m.group().strip("-_/")
            start = m.start() + m.group().find(s)
            if len(s) >= 16 and re.search("[A-Za-z]", s) and not any(a < start + len(s) and start < b for a, _, b in base) and S.is_random(s, rule):
                added.append((start, 3, start + len(s)))
        want[doc, ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + added)), sum(k == 2 for _, k, _ in base)] += 1
    got = queries.queries["op2_randomness_battery"](spark, SF).collect()
    assert Counter((r.doc_id, r.spans, r.n_hex) for r in got) == want
