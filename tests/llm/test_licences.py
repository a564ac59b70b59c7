"""License rules against plain Python and DuckDB."""

import random
import re
from re import _constants as sre
from re import _parser

import duckdb

from llm_helpers import prose
from parity import difference
from strandloom.llm import licences, queries

RULES = [(i, tier, label, keyword, re.compile(pattern), base) for i, tier, label, keyword, pattern, base in licences.rules()]
WEIGHTS = [0.99, 0.95, 0.8, 0.5]


def _sample(parsed, rng):
    out = ""
    for kind, value in parsed:
        if kind is sre.LITERAL:
            out += chr(value)
        elif kind is sre.IN:
            out += chr(rng.choice(value)[1])
        elif kind is sre.SUBPATTERN:
            out += _sample(value[3], rng)
        elif kind is sre.BRANCH:
            out += _sample(rng.choice(value[1]), rng)
        elif kind is sre.MAX_REPEAT:
            out += _sample(value[2], rng) * rng.randint(value[0], value[1])
        else:
            raise ValueError(kind)
    return out


def _scan(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    spaced = " " + "  ".join(words) + " "
    spans = []
    for i, tier, label, _, pattern, base in RULES:
        spans += [(spaced[: m.start()].count(" ") // 2, (spaced[: m.end()].count(" ")) // 2, tier, i, label, base) for m in pattern.finditer(spaced)]
    stands = [s for s in spans if s[5] or not any(
        o != s and o[2] <= s[2] and o[0] <= s[0] and o[1] >= s[1] and (o[:2] != s[:2] or o[2:4] < s[2:4]) for o in spans)]
    starts = [s[0] for s in spans if s[5]]
    listed = lambda rows: ",".join(sorted({s[4] for s in rows}))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), listed(s for s in spans if s[5]), listed(stands),
            max((WEIGHTS[s[2]] for s in stands), default=0.0), len(stands))


def _row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.n_detections


def test_every_match_holds_its_keyword():
    rng = random.Random(1)
    assert len(RULES) > 300 and len({r[2] for r in RULES}) > 100
    for rule in licences.rules():
        for _ in range(40):
            text = _sample(_parser.parse(rule[4]), rng)
            assert rule[3] in text.split() and re.fullmatch(rule[4], text)
            assert all(text[k] == " " for k in (0, -1)) and text.count(" ") == 2 * len(text.split())


def _texts():
    rng = random.Random(6)
    parsed = [_parser.parse(r[4].pattern) for r in RULES]
    out = [_sample(p, rng).strip().replace("  ", " ") for p in parsed]
    out = [prose(rng, 5) + " " + t.title() + ", " + prose(rng, 4) for t in out]
    for _ in range(60):
        out.append(" ".join(rng.choice([prose(rng, 3), _sample(rng.choice(parsed), rng), "MIT", "cc by", "-", "Apache License", "(APACHE-LICENSE)", "the", "licensed under"]) for _ in range(25)))
    return out + ["mit license " * 300, "Licensed under the Apache License, Version 2.0.", "GNU   general\npublic_license", "mit", "emit licenses", "cc by-nc 4.0", "apache licenseé"]


def test_rules_match_plain_scan(spark):
    rows = list(enumerate(_texts()))
    found = {r.doc_id: _row(r) for r in licences.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, text in rows:
        assert found[i] == _scan(text), text
    assert sum(r[1] > 0 for r in found.values()) > 20
    by = {t: found[i] for i, t in rows}
    assert by["Licensed under the Apache License, Version 2.0."][4:7] == ("apache", "apache,apache-2.0", 0.95)
    assert by["emit licenses"][1] == by["apache licenseé"][1] == 0 and by["GNU   general\npublic_license"][4] == "gpl"


def test_sql_on_many_rules(spark):
    rows = list(enumerate(_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert difference(licences.license_scan(df), con, licences.oracle()) is None


def test_edges(spark, tricky, tricky_rows, nothing):
    texts = {r[0]: r[1] for r in tricky_rows}
    found = licences.license_scan(tricky).collect()
    assert len(found) == len(tricky_rows)
    for r in found:
        assert _row(r) == _scan(texts[r.doc_id])
    assert licences.license_scan(nothing).count() == 0
    rows = [(None, "mit license"), (None, None), (None, "mit license"), (3, "mit license"), (3, "apache license"), (3, "mit license")]
    found = licences.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.labels, r.n_base) for r in found) == [(-1, "", 0), (-1, "mit", 1), (-1, "mit", 1), (3, "apache", 1), (3, "mit", 1), (3, "mit", 1)]


def test_main_path_is_native(tricky):
    plan = licences.license_scan(tricky)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "InPandas" not in plan and "BatchEvalPython" not in plan


def test_query(spark, folder, duck):
    assert difference(queries.QUERIES["op13_license_scans"](spark, folder), duck, queries.CHECKS["op13_license_scans"]) is None
