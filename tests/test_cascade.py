"""The search cascade over all part names against plain loops over all objects, products and triples."""

import json
import math
import re
from difflib import SequenceMatcher

import pytest
import xxhash

from lexspark.functions import text
from lexspark.operators import lexicon, search
from lexspark.plans import registry
from tests.conftest import SF
from tests.test_fuzzy import forms, least, similarity


def tokens(s):
    return list(dict.fromkeys(re.findall(r"[^\W_]+", s.lower())))


def asked_tokens(s):
    return [t for t in tokens(s) if t not in text.QUERY_NOISE]


def bm25(objects):
    """A function of a query and of the objects that may answer it; what a token is worth comes from all."""
    bags = {i: re.findall(r"[^\W_]+", o["text"].lower()) for i, o in objects.items()}
    mean = sum(map(len, bags.values())) / max(1, len(bags))
    df = {}
    for ws in bags.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1

    def score(query, ids):
        out = {}
        for i in ids:
            shared = [t for t in tokens(query) if t in bags[i]]
            if shared:
                parts = (math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * bags[i].count(t) * 2.2 / (bags[i].count(t) + 1.2 * (0.25 + 0.75 * len(bags[i]) / mean)) for t in shared)
                out[i] = round(sum(parts), 9)
        return out

    return score


def ranked(query, objects, score, k, ids=None):
    """(rerank score, id), the best first."""
    found = score(query, objects if ids is None else ids)
    best = sorted(found, key=lambda i: (-found[i], i))[:k]
    q = tokens(query)
    rerank = {}
    for i in best:
        t = tokens(objects[i]["text"])
        s = len(set(q) & set(t))
        rerank[i] = s / len(q) + 0.1 * s / len(t) if q and t else 0.0
    return [(rerank[i], i) for i in sorted(best, key=lambda i: (-rerank[i], best.index(i)))]


def best_code(query, objects, score):
    """(score, id) or None."""
    q = asked_tokens(query)
    k = 20 if not q or all(t.isdigit() for t in q) else {1: 75, 2: 50}.get(len(q), 20)
    if found := ranked(query, objects, score, k):
        return found[0]
    normal = forms(query)
    low, high = least([t for t in normal if t not in text.QUERY_NOISE])
    q = [t for t in normal if len(t) >= 3 and t not in text.QUERY_NOISE]
    if not q or not objects:
        return None
    every = []
    for i, o in objects.items():
        ts = [t for t in forms(o["description"]) if len(t) >= 3]
        best = [max((similarity(a, b) for b in ts), default=0.0) for a in q]
        every.append((round(sum(best) / len(q), 12), max(best), -i))
    avg, most, i = max(every)
    return (max(avg, most), -i) if avg >= low and most >= high else None


#: Least similarity of two tokens.
def threshold(n_query, a, b):
    n = min(len(a), len(b))
    return 0.9 if n_query != 1 else 0.83 if n >= 6 else 0.85 if n == 5 else 0.9


class Attributes:
    def __init__(self, names, triples):
        self.products = {p: set(tokens(p)) for p in names}
        df = {}
        for ts in self.products.values():
            for t in ts:
                df[t] = df.get(t, 0) + 1
        self.idf = {t: math.log((len(self.products) + 1) / (n + 1)) + 1 for t, n in df.items()}
        self.triples, self.score = triples, bm25(triples)

    def matches(self, q):
        """By product: (query token, product token, equal)."""
        out = {}
        for p, ts in self.products.items():
            for a in q:
                for b in ts:
                    near = a != b and min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 2
                    if a == b or near and SequenceMatcher(None, a, b).ratio() >= threshold(len(q), a, b):
                        out.setdefault(p, set()).add((a, b, a == b))
        return out

    def product(self, met):
        rows = []
        for p, found in met.items():
            exact = any(e for _, _, e in found)
            worth = [self.idf[b] for b in {b for _, b, e in found if e or not exact}]
            rows.append((-round(sum(worth), 9), p, max(worth)))
        rows.sort()
        if not rows:
            return None
        following = -rows[1][0] if len(rows) > 1 else 0.0
        return (rows[0][1], -rows[0][0]) if rows[0][2] >= 1.4 or -rows[0][0] - following >= 0.75 else None

    def best(self, query):
        """(product, type, value, score) or None."""
        q = asked_tokens(query)
        if not q:
            return None
        met = self.matches(q)
        said = {p: {a for a, _, _ in found} for p, found in met.items()}
        cues = lambda o: set(tokens(f"{o['attribute_type']} {o['attribute_value']}"))
        whole = lambda s, o: (o["product"], o["attribute_type"], o["attribute_value"], s)
        if one := self.product(met):
            left = [t for t in q if t not in said.get(one[0], ())]
            if left:
                for s, i in ranked(query, self.triples, self.score, 20, [i for i, o in self.triples.items() if o["product"] == one[0]])[:5]:
                    if set(left) & cues(self.triples[i]):
                        return whole(s, self.triples[i])
            return one[0], None, None, one[1]
        only = None
        for s, i in ranked(query, self.triples, self.score, 20)[:5]:
            o = self.triples[i]
            here = said.get(o["product"], set())
            rest = set(q) - here
            if rest & cues(o) if here else set(q) & cues(o):
                return whole(s, o)
            if here and not rest and only is None:
                only = (o["product"], None, None, s)
        return only


@pytest.fixture(scope="module")
def parts(spark):
    return spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type").collect()


@pytest.fixture(scope="module")
def attributes(parts):
    triples = {}
    for r in parts:
        for kind, value in (("brand", r["p_brand"]), ("type", r["p_type"])):
            line = f"{r['p_name']}: {kind} : {value}"
            h = xxhash.xxh64_intdigest(line.encode(), seed=42)
            triples[h - (h >> 63 << 64)] = {"text": line, "product": r["p_name"], "attribute_type": kind, "attribute_value": value}
    return Attributes({r["p_name"] for r in parts}, triples)


def near(score):
    return None if score is None else round(score, 6)


def test_attributes_equal_a_plain_loop(spark, parts, attributes):
    want = {}
    for name in {r["p_name"] for r in parts}:
        if found := attributes.best(f"{name[:2]}{name[3:]} economy"):
            want[name] = (*found[:3], near(found[3]))
    got = {r["query_id"]: (r["product"], r["attribute_type"], r["attribute_value"], near(r["score"])) for r in registry.QUERIES["q40_attribute"](spark, SF).collect()}
    assert got == want and len(want) > 10


def test_answers_equal_a_plain_loop(spark, parts, attributes):
    first = {}
    for r in parts:
        first[r["p_name"]] = min(first.get(r["p_name"], r["p_partkey"]), r["p_partkey"])
    six = {i: {"text": f"{i:06d} {name}", "description": name, "code": f"{i:06d}"} for name, i in first.items()}
    national = {i: o for i, o in six.items() if i % 2 == 0}
    of_six, of_national = bm25(six), bm25(national)
    want = {}
    for name in first:
        country = best_code(name, national, of_national)
        code = country or best_code(name, six, of_six)
        a = attributes.best(name)
        want[name] = {
            "query": name,
            "six_digit": code and {"code": six[code[1]]["code"], "description": six[code[1]]["description"], "score": near(code[0])},
            "national": country and {"country": "US", "code": six[country[1]]["code"] + "0010", "description": six[country[1]]["description"], "score": near(country[0])},
            "attribute": a and {"triple": a[0] if a[1] is None else f"{a[0]}: {a[1]} : {a[2]}", "product": a[0], "attribute_type": a[1], "attribute_value": a[2], "score": near(a[3])},
        }
    got = {r["query_id"]: json.loads(r["json"]) for r in registry.QUERIES["q42_answer"](spark, SF).collect()}
    for g in got.values():
        for slot in ("six_digit", "national", "attribute"):
            if g[slot]:
                g[slot]["score"] = near(g[slot]["score"])
    assert got == want


def test_products_outside_the_lexicon_are_known_by_name(spark):
    """A product that only triples have: alone where the query says no more, else its attribute."""
    triples = [(1, "Green Tea", "Form", "Leaf"), (2, "Green Tea", "Form", "Powder"), (3, "Black Pepper", "Origin", "Malabar"), (4, "", "Form", "Leaf")]
    rows = spark.createDataFrame([(*t, [], " ".join(t[1:])) for t in triples], "object_id long, product string, attribute_type string, attribute_value string, keywords array<string>, text string")
    tokens = lexicon.product_tokens(spark.createDataFrame([("Black Pepper", ["kali mirch"])], "id string, keywords array<string>"))
    asked = spark.createDataFrame([("a", "green tea"), ("b", "green tea powder"), ("c", "grean tea"), ("d", "malabar"), ("e", "nothing known")], "query_id string, query string")
    got = {r["query_id"]: (r["product"], r["attribute_value"]) for r in search.best_attribute(asked, rows, tokens, search.Options()).collect()}
    assert got == {"a": ("Green Tea", None), "b": ("Green Tea", "Powder"), "d": ("Black Pepper", "Malabar")}
