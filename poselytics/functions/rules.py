"""Rule text and threshold rules as Spark column expressions."""

from __future__ import annotations

import ast
from pyspark.sql import Column
from pyspark.sql import functions as F

from poselytics.functions.angles import nan_to_null

# what a comparison says of a left side that is less, equal, greater, or has no order (NaN)
_COMPARE = {
    ast.Lt: (True, False, False, False),
    ast.LtE: (True, True, False, False),
    ast.Gt: (False, False, True, False),
    ast.GtE: (False, True, True, False),
    ast.Eq: (False, True, False, False),
    ast.NotEq: (True, False, True, True),
}

_ARITHMETIC = {
    "Add": "{0} + {1}",
    "Sub": "{0} - {1}",
    "Mult": "{0} * {1}",
    "Div": "try_divide({0}, {1})",
    # the sign of a remainder is the divisor's
    "Mod": "(try_mod({0}, {1}) + CASE WHEN try_mod({0}, {1}) * sign({1}) < 0 THEN {1} ELSE double('0') END)",
    "Pow": "power({0}, {1})",
}

NO_STATE = -1


def _simple(node: ast.expr) -> dict | None:
    if isinstance(node, ast.Name):
        return {"angle": node.id}
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return {"value": float(node.value)}
    return None


def _steps(node: ast.expr, text: str) -> list[dict]:
    """Arithmetic in postfix order."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return [*_steps(node.operand, text), {"op": "USub"}]
    if isinstance(node, ast.BinOp) and type(node.op).__name__ in _ARITHMETIC:
        return [*_steps(node.left, text), *_steps(node.right, text), {"op": type(node.op).__name__}]
    if simple := _simple(node):
        return [{"op": "read", **simple}]
    raise ValueError(f"unsupported value in condition: {text!r}")


def state_terms(conditions: list[str]) -> list[dict]:
    """Catalog conditions such as ``a <= 110 and a > 70``, in order, as one list of comparisons.

    A comparison has a place, counted down to 0, and tells for each outcome the place to go on at:
    ``NO_STATE`` if no condition is left, ``NO_STATE - 1 - n`` if the n-th (from 0) holds. So only
    what decides is ever read. An angle is compared with a number, or ``left`` with ``right``. Only angle
    names, numbers, comparisons, ``and/or/not`` and ``+ - * / % **`` are accepted; catalog text can never run code.
    """
    terms: list[dict] = []

    def compare(op: ast.cmpop, left: ast.expr, right: ast.expr, text: str, yes: int, no: int) -> int:
        if type(op) not in _COMPARE:
            raise ValueError(f"unsupported comparison in condition: {text!r}")
        less, equal, greater, unordered = (yes if holds else no for holds in _COMPARE[type(op)])
        a, b = _simple(left) or {}, _simple(right) or {}
        if "value" in a and "angle" in b:
            a, b, less, greater = b, a, greater, less
        if "angle" in a and "value" in b:
            sides = {**a, **b}
        else:
            names = [n.id for side in (left, right) for n in ast.walk(side) if isinstance(n, ast.Name)]
            sides = {"names": names, "left": _steps(left, text), "right": _steps(right, text)}
        outcomes = {"less": less, "equal": equal, "greater": greater, "unordered": unordered}
        terms.append({"place": len(terms), **sides, **outcomes})
        return len(terms) - 1

    def add(node: ast.expr, text: str, yes: int, no: int) -> int:
        """Where to begin with ``node``; what follows it is in the list already."""
        if isinstance(node, ast.BoolOp):
            both = isinstance(node.op, ast.And)
            for value in reversed(node.values):
                first = add(value, text, yes, no)
                yes, no = (first, no) if both else (yes, first)
            return first
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return add(node.operand, text, no, yes)
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            for op, left, right in reversed(list(zip(node.ops, sides, sides[1:]))):
                yes = compare(op, left, right, text, yes, no)
            return yes
        raise ValueError(f"unsupported condition: {text!r}")

    after = NO_STATE
    for n, text in reversed(list(enumerate(conditions))):
        after = add(ast.parse(text, mode="eval").body, text, NO_STATE - 1 - n, after)
    return terms[::-1]


#: Most cells of a decision table; exercises that need more keep their comparisons and rules.
MAX_CELLS = 4096


class DecisionTable:
    """What every combination of intervals of the angles leads to.

    The constants that an angle is compared with cut its axis: below the first, equal to it, between it
    and the second and so on, 2 m + 1 places for m constants; then one for a value without order (NaN or null)
    and one for an angle that is absent. A cell is a place on each axis, and its number the sum
    of places times strides. ``state_cells`` tells where the comparisons end in it (None if they read an absent angle) and
    ``rule_cells`` which of ``outcomes``, pairs of feedback ids and whether one is critical, its rules give.
    Either is None where it would have over ``MAX_CELLS`` cells, or compares more than an angle with a number.
    """

    def __init__(
        self,
        terms: list[dict],
        rules: tuple[tuple[str, float | None, float | None, str, bool], ...],
        stop_at_critical: bool,
    ) -> None:
        simple = all("names" not in t for t in terms)
        in_states = list(dict.fromkeys(t["angle"] for t in terms)) if simple else []
        in_rules = list(dict.fromkeys(r[0] for r in rules))
        self.axes = list(dict.fromkeys(in_states + in_rules))
        found: dict[str, set[float]] = {angle: set() for angle in self.axes}
        for t in terms if simple else []:
            found[t["angle"]].add(float(t["value"]))
        for angle, low, high, _, _ in rules:
            found[angle] |= {float(x) for x in (low, high) if x is not None}
        self.cuts = [sorted(found[angle]) for angle in self.axes]
        self._at = [{value: 2 * k + 1 for k, value in enumerate(cuts)} for cuts in self.cuts]
        self.outcomes: list[tuple[tuple[str, ...], bool]] = []
        self.state_strides, self.state_cells = self._table(in_states, lambda c: self._end(terms, c)) if simple else ([], None)
        self.rule_strides, self.rule_cells = self._table(in_rules, lambda c: self._outcome(rules, c, stop_at_critical))

    def _table(self, angles: list[str], value) -> tuple[list[int], list | None]:
        """Strides by axis, 0 for one that does not matter, and the value of each cell."""
        sizes = [2 * len(cuts) + 3 if angle in angles else 1 for angle, cuts in zip(self.axes, self.cuts, strict=True)]
        strides, n = [], 1
        for size in sizes:
            strides.append(n if size > 1 else 0)
            n *= size
        if n > MAX_CELLS:
            return strides, None
        cells = []
        for cell in range(n):
            places = []
            for size in sizes:
                cell, place = divmod(cell, size)
                places.append(place)
            cells.append(value(dict(zip(self.axes, places, strict=True))))
        return strides, cells

    def _end(self, terms: list[dict], places: dict[str, int]) -> int | None:
        by_place = {t["place"]: t for t in terms}
        at = len(terms) - 1
        while at >= 0:
            term = by_place[at]
            axis = self.axes.index(term["angle"])
            place, highest = places[term["angle"]], 2 * len(self.cuts[axis])
            if place == highest + 2:
                return None
            mark = self._at[axis][float(term["value"])]
            order = "unordered" if place > highest else "less" if place < mark else "greater" if place > mark else "equal"
            at = term[order]
        return at

    def _outcome(self, rules: tuple, places: dict[str, int], stop_at_critical: bool) -> int:
        ids, any_critical = [], False
        for angle, low, high, feedback, critical in rules:
            axis = self.axes.index(angle)
            place = places[angle]
            if place > 2 * len(self.cuts[axis]):
                continue
            below = low is not None and place < self._at[axis][float(low)]
            above = high is not None and place > self._at[axis][float(high)]
            if below or above:
                ids.append(feedback)
                any_critical |= critical
                if critical and stop_at_critical:
                    break
        outcome = (tuple(ids), any_critical)
        if outcome not in self.outcomes:
            self.outcomes.append(outcome)
        return self.outcomes.index(outcome)


def cell_steps(n_axes: int, n_cuts: int, angles: str) -> list[list[str]]:
    """Projections, one after another, that end with ``_state_cell`` and ``_rule_cell``.

    They read the columns ``_axes``, ``_cuts``, ``_state_strides`` and ``_rule_strides``. Each axis takes a binary search,
    unrolled for at most ``n_cuts`` cuts, so that it needs no lambda and stays in generated code.
    """
    axes = range(n_axes)
    steps = [[f"{angles}[get(_axes, {j})] AS _v{j}" for j in axes]]
    names = ["0" for _ in axes]
    width = 1 << max(n_cuts, 1).bit_length() - 1
    while width:
        steps.append(
            [
                f"if(_v{j} > get(get(_cuts, {j}), {names[j]} + {width - 1}), {names[j]} + {width}, {names[j]}) AS _k{j}_{width}"
                for j in axes
            ]
        )
        names = [f"_k{j}_{width}" for j in axes]
        width //= 2
    # an absent angle and one without a value differ; a list of angles that is too short for the axis has neither
    steps.append(
        [
            f"CASE WHEN _v{j} IS NULL THEN 2 * size(get(_cuts, {j})) + "
            f"if(coalesce(map_contains_key({angles}, get(_axes, {j})), false), 1, 2) "
            f"WHEN isnan(_v{j}) THEN 2 * size(get(_cuts, {j})) + 1 "
            f"ELSE 2 * {names[j]} + if(get(get(_cuts, {j}), {names[j]}) = _v{j}, 1, 0) END AS _p{j}"
            for j in axes
        ]
    )
    cell = lambda strides: " + ".join(["0", *[f"coalesce(_p{j} * get({strides}, {j}), 0)" for j in axes]])
    steps.append([f"{cell('_state_strides')} AS _state_cell", f"{cell('_rule_strides')} AS _rule_cell"])
    return steps


def first_state_sql(terms: str, angles: str) -> str:
    """Where the comparisons of ``state_terms`` end; NULL if one reads an angle that the map lacks."""

    def angle(name: str) -> str:
        return f"nanvl({angles}[{name}], NULL)"

    def absent(name: str) -> str:
        return f"NOT coalesce(map_contains_key({angles}, {name}), false)"

    def decide(left: str, right: str, otherwise: str) -> str:
        return (
            f"CASE WHEN {left} < {right} THEN t.less WHEN {left} > {right} THEN t.greater "
            f"WHEN {left} = {right} THEN t.equal {otherwise} ELSE t.unordered END"
        )

    def value(side: str) -> str:
        work = " ".join(
            f"WHEN '{op}' THEN concat(array(nanvl({text.format('s[1]', 's[0]')}, NULL)), slice(s, 3, size(s)))"
            for op, text in _ARITHMETIC.items()
        )
        read = f"concat(array(CASE WHEN o.angle IS NULL THEN o.value ELSE {angle('o.angle')} END), s)"
        step = f"CASE o.op WHEN 'read' THEN {read} WHEN 'USub' THEN concat(array(-s[0]), slice(s, 2, size(s))) {work} END"
        return f"aggregate({side}, CAST(array() AS ARRAY<DOUBLE>), (s, o) -> {step}, s -> s[0])"

    simple = decide(angle("t.angle"), "t.value", f"WHEN {absent('t.angle')} THEN CAST(NULL AS INT)")
    worked = decide(value("t.left"), value("t.right"), "")
    step = (
        f"CASE WHEN at != t.place THEN at WHEN t.angle IS NOT NULL THEN {simple} "
        f"WHEN exists(t.names, n -> {absent('n')}) THEN CAST(NULL AS INT) ELSE {worked} END"
    )
    # once at is NULL, it stays so: an angle was missing
    return f"aggregate({terms}, size({terms}) - 1, (at, t) -> CASE WHEN at IS NOT NULL THEN {step} END)"


def violated_rules(rules: Column, angles: Column) -> Column:
    """Rules of the array whose strict bound is broken; open bounds and absent angles pass."""

    def broken(rule: Column) -> Column:
        value = nan_to_null(angles[rule["angle"]])
        return F.coalesce(value < rule["min"], F.lit(False)) | F.coalesce(
            value > rule["max"], F.lit(False)
        )

    return F.filter(rules, broken)


def up_to_first_critical(violated: Column) -> Column:
    """Cut the violated rules after the first critical one (itself kept)."""

    def cut(rules: Column) -> Column:
        first = F.array_position(F.transform(rules, lambda r: F.coalesce(r["critical"], F.lit(False))), True)
        return F.slice(rules, F.lit(1), F.when(first > 0, first.cast("int")).otherwise(F.size(rules)))

    # binding the array as a lambda variable evaluates the rules once, not once per use
    return F.transform(F.array(violated), cut)[0]
