"""Rules by the ten thousand: an index over their distinct tests in place of one predicate per rule.

A rule set is taken apart into distinct tests (column, kind, value). All literal tests of a column
are found in one pass over each distinct value of a batch, by one multi-pattern automaton; numbers are
compared as arrays; patterns and networks stay built-in expressions, each distinct one once. Every rule
is filed under a small set of tests of which at least one must be met for the rule to hold, so a batch
looks only at rules filed under a test that it meets, and decides their conditions on the bitmaps of
the tests. The result is that of ``rules.detect``, from one scan without a shuffle of events.

A rule set is configuration: it is read on the driver and travels to the tasks with the function.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.net import any_of, in_networks
from wardlake.functions.text import once
from wardlake.operators.rules import (CATEGORY_CLASS, LOW, NESTED, Fields, Rule, _column, _is_regex, described, logsource_guard, nested_fields,
                                      read_condition)

PLACES = ("contains", "startswith", "endswith", "equals")
NUMBERS = {"gt": np.greater, "gte": np.greater_equal, "lt": np.less, "lte": np.less_equal}
# how many events a kind of test lets through, roughly; only the choice of what a rule is filed under depends on it
BREADTH = {"equals": 1, "contains": 2, "startswith": 2, "endswith": 2, "pattern": 20, "network": 20, "null": 300}
NUMBER_BREADTH, GUARD_BREADTH = 300, 1000


class Test(NamedTuple):
    """``of``: low (lower-cased text), text, number, event (all values joined) or source."""

    of: str
    column: str
    kind: str
    value: str | float | None


class RuleIndex(NamedTuple):
    """Tests by number; per rule its condition over test numbers and the tests it is filed under (None: looked at in every batch)."""

    rules: list[Rule]
    tests: list[Test]
    trees: list
    filed: list[tuple[int, ...] | None]
    rejected: list[tuple[str, str]]


# ------------------------------------------------------------------------------- rules to tests


def field_tree(column: str | None, modifiers: list[str], values) -> tuple:
    """One 'field|modifiers: values' entry as a tree of tests; the same reading as rules.match_field."""
    if column is None:
        return "or", []
    if values is None:
        return "is", [Test("low", column, "null", None)]
    items = values if isinstance(values, (list, tuple)) else [values]
    mods = [m for m in modifiers if m != "all"]
    kind = mods[0] if mods else ""

    def one(v) -> tuple:
        s = str(v)
        if kind == "re":
            return ("is", [Test("low", column, "pattern", s)]) if _is_regex(s) else ("or", [])
        if kind == "cidr":
            return "is", [Test("text", column, "network", s)]
        if kind == "base64":
            place = mods[1] if len(mods) > 1 and mods[1] in PLACES else "equals"
            return "is", [Test("text", column, place, base64.b64encode(s.encode()).decode())]
        if kind in NUMBERS:
            return "is", [Test("number", column, kind, float(s))]
        return "is", [Test("low", column, kind if kind in PLACES[:3] else "equals", s.lower())]

    return ("and" if "all" in modifiers else "or"), [one(v) for v in items]


def selection_tree(sel, fields: Fields) -> tuple:
    if isinstance(sel, Mapping):
        parts = [(str(key).split("|"), values) for key, values in sel.items()]
        return "and", [field_tree(fields.name(name), mods, values) for (name, *mods), values in parts]
    if isinstance(sel, (list, tuple)) and sel and all(isinstance(x, Mapping) for x in sel):
        return "or", [selection_tree(x, fields) for x in sel]
    words = sel if isinstance(sel, (list, tuple)) else [sel]
    return "or", [("is", [Test("event", "", "contains", str(w).lower())]) for w in words]


def guard_tree(rule: Rule) -> tuple:
    """rules.logsource_guard as a tree."""
    parts = []
    if rule.product:
        parts.append(("is", [Test("source", "source", "equals", rule.product.lower())]))
    if rule.category in CATEGORY_CLASS:
        parts.append(("is", [Test("source", "class_uid", "equals", str(CATEGORY_CLASS[rule.category]))]))
    unbound = not (rule.product or rule.category or rule.service)
    return ("or", parts) if parts else ("and" if unbound else "or", [])


def filed_under(tree, breadth: list[int]) -> tuple[int, frozenset[int]] | None:
    """(breadth, tests): without one of these tests the tree is false. None where it can hold without any test."""
    if isinstance(tree, int):
        return breadth[tree], frozenset([tree])
    op, parts = tree
    if op == "not":
        return None
    under = [filed_under(p, breadth) for p in parts]
    if op == "and":
        return min((u for u in under if u is not None), key=lambda u: u[0], default=None)
    if None in under:
        return None
    return sum(u[0] for u in under), frozenset().union(*(u[1] for u in under))


def build_index(rules: Iterable[Rule], columns: Iterable[str]) -> RuleIndex:
    """The enabled rules over a table with these columns; a rule that cannot be read is rejected with its reason and stops no other."""
    columns = list(columns)
    numbers: dict[Test, int] = {}
    fields: dict[str | None, Fields] = {}
    kept, trees, rejected = [], [], []

    def numbered(tree: tuple):
        op, parts = tree
        return numbers.setdefault(parts[0], len(numbers)) if op == "is" else (op, [numbered(p) for p in parts])

    def rule_tree(rule: Rule) -> tuple:
        if rule.category not in fields:
            fields[rule.category] = Fields(columns, rule.category)
        of = fields[rule.category]
        named = {str(n): selection_tree(sel, of) for n, sel in rule.detection.items() if n != "condition"}

        def put(tree: tuple) -> tuple:
            op, parts = tree
            return named[parts[0]] if op == "is" else (op, [put(p) for p in parts])

        return "and", [guard_tree(rule), put(read_condition(str(rule.detection["condition"]), named))]

    for rule in rules:
        if not rule.enabled:
            continue
        try:
            tree = rule_tree(rule)
        except Exception as e:
            rejected.append((rule.id, f"{type(e).__name__}: {e}"))
            continue
        kept.append(rule)
        trees.append(numbered(tree))
    tests = list(numbers)
    breadth = [GUARD_BREADTH if t.of == "source" else NUMBER_BREADTH if t.of == "number" else BREADTH[t.kind] for t in tests]
    under = [filed_under(t, breadth) for t in trees]
    return RuleIndex(kept, tests, trees, [None if u is None else tuple(sorted(u[1])) for u in under], rejected)


# ------------------------------------------------------------------------------- tests on a batch


class Literals:
    """All literal tests of one text column: (test number, kind, value)."""

    def __init__(self, tests: list[tuple[int, str, str]]):
        self.free = [i for i, kind, value in tests if not value and kind != "equals"]
        self.blank = [i for i, kind, value in tests if not value and kind == "equals"]
        needles: dict[str, list[tuple[int, str]]] = {}
        for i, kind, value in tests:
            if value:
                needles.setdefault(value, []).append((i, kind))
        self.automaton = ahocorasick.Automaton()
        for value, users in needles.items():
            self.automaton.add_word(value, (len(value), users))
        self.any = bool(needles)
        if self.any:
            self.automaton.make_automaton()

    def met(self, text: str) -> set[int]:
        out, last = set(self.free), len(text) - 1
        if not text:
            out.update(self.blank)
        elif self.any:
            for end, (size, users) in self.automaton.iter(text):
                first, final = end + 1 == size, end == last
                for i, kind in users:
                    if kind == "contains" or (first or kind == "endswith") and (final or kind == "startswith"):
                        out.add(i)
        return out


class Texts(NamedTuple):
    """Where a batch's values lie among its distinct ones, and the distinct values that meet each test."""

    at: np.ndarray
    distinct: int
    met: dict[int, list[int]]


def read_texts(values: pa.Array, literals: Literals | None) -> Texts:
    coded = values.dictionary_encode()
    at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    met: dict[int, list[int]] = {}
    if literals is not None:
        for v, text in enumerate(coded.dictionary):
            for i in literals.met(text.as_py()):
                met.setdefault(i, []).append(v)
    return Texts(at, len(coded.dictionary), met)


def compare(kind: str, numbers: pa.Array, bound: float) -> np.ndarray:
    """As SQL compares: null meets nothing; not-a-number equals itself and is above all else."""
    x = numbers.to_numpy(zero_copy_only=False)
    x_nan, b_nan = np.isnan(x), np.isnan(bound)
    with np.errstate(invalid="ignore"):
        plain = NUMBERS[kind](x, bound)
    odd = NUMBERS[kind](x_nan.astype(int), int(b_nan))
    return np.where(x_nan | b_nan, odd, plain) & numbers.is_valid().to_numpy(zero_copy_only=False)


def holds(tree, mask, n: int) -> np.ndarray:
    if isinstance(tree, int):
        return mask(tree)
    op, parts = tree
    if op == "not":
        return ~holds(parts[0], mask, n)
    out = np.full(n, op == "and")
    for part in parts:
        if op == "and":
            out &= holds(part, mask, n)
            if not out.any():
                break
        else:
            out |= holds(part, mask, n)
    return out


def matcher(index: RuleIndex, inputs: list[tuple[str, str]]):
    """-> fn(columns of a batch in the order of ``inputs``) -> list of rule numbers per row."""
    slot = {key: i for i, key in enumerate(inputs)}
    per: dict[tuple[str, str], list[tuple[int, str, str]]] = {}
    loose: list[int] = []  # numbers, nulls and (by their own inputs) patterns
    for i, t in enumerate(index.tests):
        if t.kind in PLACES:
            per.setdefault((t.of, t.column), []).append((i, t.kind, t.value))
        elif t.of == "number" or t.kind == "null":
            loose.append(i)
    literals = {key: Literals(tests) for key, tests in per.items()}
    filed: dict[int, list[int]] = {}
    for r, under in enumerate(index.filed):
        for i in under or ():
            filed.setdefault(i, []).append(r)
    always = [r for r, under in enumerate(index.filed) if under is None]

    def run(columns: tuple[pa.Array, ...]) -> pa.Array:
        n = len(columns[0])
        texts = {key: read_texts(columns[slot[key]], literals.get(key)) for key in inputs if key[0] in ("low", "text", "event", "source")}
        known: dict[int, np.ndarray] = {}
        for i in loose:
            t = index.tests[i]
            known[i] = texts["low", t.column].at < 0 if t.kind == "null" else compare(t.kind, columns[slot["number", t.column]], t.value)
        for key in inputs:
            if key[0] == "built":  # tests evaluated by built-in expressions: the numbers of those met, per row
                lists = columns[slot[key]]
                rows = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                numbers = lists.flatten().to_numpy(zero_copy_only=False)
                order = np.argsort(numbers, kind="stable")
                for i, first, last in zip(*_runs(numbers[order])):
                    known[int(i)] = np.bincount(rows[order[first:last]], minlength=n).astype(bool)
        nothing = np.zeros(n, bool)

        def mask(i: int) -> np.ndarray:
            if i not in known:
                t = index.tests[i]
                at = texts.get((t.of, t.column))
                if t.kind not in PLACES or i not in at.met:
                    return nothing
                flags = np.zeros(at.distinct + 1, bool)  # the last place stands for null
                flags[at.met[i]] = True
                known[i] = flags[at.at]
            return known[i]

        met = {i for t in texts.values() for i in t.met} | {i for i, m in known.items() if m.any()}
        rows, rules = [], []
        for r in sorted({r for i in met for r in filed.get(i, ())}.union(always)):
            hit = np.flatnonzero(holds(index.trees[r], mask, n))
            if len(hit):
                rows.append(hit)
                rules.append(np.full(len(hit), r, np.int32))
        if not rows:
            return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
        rows, rules = np.concatenate(rows), np.concatenate(rules)
        order = np.argsort(rows, kind="stable")
        ends = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rules[order]))

    return run


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, end) of each run of equal values."""
    values, first = np.unique(ordered, return_index=True)
    return values, first, np.append(first[1:], len(ordered))


# ------------------------------------------------------------------------------- over a table


def detect(ev: DataFrame, rules: Iterable[Rule], per_block: int = 200) -> DataFrame:
    """rules.detect for rule sets too large to compile one by one: the same rows, one per (event, matching rule).

    Only the columns that some test reads go through Arrow; the rest of the event stays where it is.
    A rule set without a usable rule gives no rows.
    """
    rules, own = [r for r in rules if r.enabled], ev.columns
    ev = ev.withColumns({NESTED + path: F.col(path) for path in nested_fields(rules, own)})
    columns = ev.columns
    index = build_index(rules, columns)

    # patterns and networks, each under the log sources of the rules that use it
    users: dict[int, set[tuple]] = {}
    sources: dict[tuple, Rule] = {}

    def visit(tree, key: tuple) -> None:
        if isinstance(tree, int):
            if index.tests[tree].kind in ("pattern", "network"):
                users.setdefault(tree, set()).add(key)
        else:
            for part in tree[1]:
                visit(part, key)

    for rule, tree in zip(index.rules, index.trees):
        key = (rule.product or "", rule.category or "", bool(rule.service))
        sources.setdefault(key, rule)
        visit(tree, key)
    lowered = sorted({index.tests[i].column for i in users if index.tests[i].kind == "pattern"})
    if lowered:
        ev = once(ev, **{LOW + c: F.lower(_column(c).cast("string")) for c in lowered})

    def built(i: int) -> Column:
        t = index.tests[i]
        met = _column(LOW + t.column).rlike("(?i)" + t.value) if t.kind == "pattern" else in_networks(_column(t.column).cast("string"), [t.value])
        return F.when(met, F.lit(i))

    groups: dict[frozenset, list[int]] = {}
    for i, keys in users.items():
        groups.setdefault(frozenset(keys), []).append(i)
    blocks = []
    for keys, members in groups.items():
        guard = any_of([logsource_guard(sources[k]) for k in sorted(keys)])
        for at in range(0, len(members), per_block):
            blocks.append(F.when(guard, F.array_compact(F.array(*[built(i) for i in members[at:at + per_block]]))).otherwise(F.array().cast("array<int>")))

    def value(of: str, column: str) -> Column:
        if of == "event":
            return F.lower(F.concat_ws("\x01", *[_column(c).cast("string") for c in sorted(c for c in columns if not c.startswith(NESTED))]))
        text = _column(column).cast("string")
        return {"text": text, "number": text.try_cast("double")}.get(of, F.lower(text))

    inputs = sorted({(t.of, t.column) for t in index.tests if t.kind not in ("pattern", "network")})
    given = [value(*key) for key in inputs] + blocks + [F.lit(0)]
    inputs += [("built", str(b)) for b in range(len(blocks))]

    @F.arrow_udf("array<int>")
    def numbers(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        run = matcher(index, inputs)
        for batch in batches:
            yield run(batch)

    hit = ev.withColumn("_rules", numbers(*given)).select(*own, F.explode("_rules").alias("_rule"))
    return described(hit, index.rules)
