"""Articulatory features, sound change and timed sound rules as Column expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import col, remove_chars

_INDEX = {name: i for i, name in enumerate(fixed.FEATURES)}
_ZERO = (0.0,) * len(fixed.FEATURES)


def _vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def phone_features(phone: Column | str) -> Column:
    """The 14 features of a phone; zeros for a symbol outside the inventory."""
    table = F.create_map(*[x for p, f in fixed.PHONES for x in (F.lit(p), _vector(f))])
    return F.coalesce(F.element_at(table, col(phone)), _vector(_ZERO))


def nearest_phone(features: Column | str) -> Column:
    """The phone at the least Euclidean distance; ties go to the first listed."""
    inventory = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(p).alias("phone"), _vector(f).alias("feat"))
        for i, (p, f) in enumerate(fixed.PHONES)
    ])

    def candidate(entry: Column) -> Column:
        gaps = F.zip_with(col(features), entry["feat"], lambda a, b: (a - b) * (a - b))
        total = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g)
        return F.struct(F.sqrt(total).alias("dist"), entry["ord"].alias("ord"), entry["phone"].alias("phone"))

    return F.array_min(F.transform(inventory, candidate))["phone"]


def drift_rate(delta: Column | str) -> Column:
    """Strength of change for a time gap, 0 to 1."""
    return F.pow(F.least(F.lit(1.0), F.abs(col(delta)) / F.lit(float(fixed.DRIFT_SPAN))), F.lit(fixed.DRIFT_POWER))


def drift_features(features: Column | str, delta: Column | str) -> Column:
    """Feature vector after a time gap (no gap counts as the past)."""
    features, delta = col(features), col(delta)
    alpha = drift_rate(delta)

    def holds(tests) -> Column:
        out = F.lit(True)
        for name, op, value in tests:
            at = F.get(features, F.lit(_INDEX[name]))
            out = out & ((at == F.lit(float(value))) if op == "=" else (at != F.lit(float(value))))
        return out

    def change(kind: str, name: str) -> Column:
        total = F.lit(0.0)
        for chain in fixed.DRIFT[kind]:
            step = None
            for tests, rates in chain:
                rate = F.lit(float(rates.get(name, 0.0)))
                step = F.when(holds(tests), rate) if step is None else step.when(holds(tests), rate)
            total = total + step.otherwise(F.lit(0.0))
        return total

    vowel = F.get(features, F.lit(_INDEX["syll"])) == F.lit(1.0)
    moved = {n for chains in fixed.DRIFT.values() for chain in chains for _, rates in chain for n in rates}
    out = []
    for i, name in enumerate(fixed.FEATURES):
        value = F.get(features, F.lit(i))
        if name in moved:
            rate = F.when(delta > 0, F.when(vowel, change(("vowel", "future"), name))
                          .otherwise(change(("other", "future"), name))) \
                .otherwise(F.when(vowel, change(("vowel", "past"), name))
                           .otherwise(change(("other", "past"), name)))
            value = value + rate * alpha
        out.append(value)
    return F.array(*out)


def phones(ipa: Column | str) -> Column:
    """One code point each, after slashes and brackets are removed."""
    return F.filter(F.split(remove_chars(ipa, "/[]"), ""), lambda p: p != "")


def spell(features: Column | str) -> Column:
    """A pronunciation from a sequence of feature vectors, between slashes."""
    letters = F.array_join(F.transform(col(features), nearest_phone), "")
    return F.concat(F.lit("/"), letters, F.lit("/"))


# Sound shift of whole pronunciations. The drift of a listed phone is a straight
# line in the drift rate, so which phone is nearest changes only where two of
# the 35 distances cross. Those crossings are found once from the inventory,
# and a pronunciation is then rewritten with native string replacement.

def _rates(features, when: str):
    kind = "vowel" if features[0] == 1 else "other"
    total = dict.fromkeys(fixed.FEATURES, 0.0)
    for chain in fixed.DRIFT[(kind, when)]:
        for tests, rates in chain:
            if all((features[_INDEX[n]] == v) == (op == "=") for n, op, v in tests):
                for n, r in rates.items():
                    total[n] += r
                break
    return [total[n] for n in fixed.FEATURES]


def _nearest(features) -> str:
    return min(
        (sum((a - b) ** 2 for a, b in zip(features, feat)) ** 0.5, i, p)
        for i, (p, feat) in enumerate(fixed.PHONES)
    )[2]


@lru_cache(maxsize=None)
def shift_table(when: str) -> tuple[tuple[float, dict[str, str]], ...]:
    """((drift rate above which it applies, {phone: phone}), ...), ascending.

    The key '' stands for any symbol outside the inventory.
    """
    sources = [("", _ZERO), *fixed.PHONES]
    cuts = {0.0}
    for _, f in sources:
        rates = _rates(f, when)
        lines = []
        for _, g in fixed.PHONES:
            lines.append((sum((a - b) ** 2 for a, b in zip(f, g)),
                          2 * sum(r * (a - b) for r, a, b in zip(rates, f, g))))
        for c1, s1 in lines:
            for c2, s2 in lines:
                if s1 != s2 and 0 < (c2 - c1) / (s1 - s2) < 1:
                    cuts.add(round((c2 - c1) / (s1 - s2), 12))
    edges = sorted(cuts) + [1.0]
    table: list[tuple[float, dict[str, str]]] = []
    for low, high in zip(edges, edges[1:]):
        at = (low + high) / 2
        row = {p: _nearest([a + at * r for a, r in zip(f, _rates(f, when))]) for p, f in sources}
        if not table or table[-1][1] != row:
            table.append((low, row))
    return tuple(table)


def _rewrite(clean: Column, row: dict[str, str]) -> Column:
    known = "".join(re.escape(p) for p in row if p)
    out = F.regexp_replace(clean, f"[^{known}]", row[""])
    moved = [p for p in row if p and row[p] != p]
    return F.translate(out, "".join(moved), "".join(row[p] for p in moved)) if moved else out


def sound_shift(ipa: Column | str, delta: Column | str) -> Column:
    """The pronunciation ``delta`` years away, between slashes.

    Equal to ``spell(transform(phones(ipa), p -> drift_features(features(p), delta)))``.
    """
    clean, delta, alpha = remove_chars(ipa, "/[]"), col(delta), drift_rate(delta)

    def by_rate(when: str) -> Column:
        levels = shift_table(when)
        out = _rewrite(clean, levels[0][1])
        for above, row in levels[1:]:
            out = F.when(alpha > above, _rewrite(clean, row)).otherwise(out)
        return out

    shifted = F.when(delta > 0, by_rate("future")).when(delta.isNotNull(), by_rate("past"))
    return F.concat(F.lit("/"), shifted, F.lit("/"))


def timed_rules(ipa: Column | str, time: Column | str) -> Column:
    """Replace sounds whose period covers ``time``: vowels, then consonants, in order."""
    out, time = col(ipa), col(time)
    for sound, target, first, last, context in fixed.VOWEL_SHIFTS + fixed.CONSONANT_SHIFTS:
        if context is None:
            new = F.replace(out, F.lit(sound), F.lit(target))
        else:
            new = F.regexp_replace(out, sound + context, target + context[-1])
        out = F.when(time.between(first, last), new).otherwise(out)
    return out


# Forms of one word: array<struct<rank, time_period, phonetic_representation, ...>>.

def closest_form(forms: Column | str, time: Column, window: int | None = None) -> Column:
    """The form nearest in time (ties: earlier period, then lower rank); null if none.

    With ``window`` only forms at most that many years away count.
    """
    forms = F.filter(col(forms), lambda f: f["time_period"].isNotNull())
    if window is not None:
        forms = F.filter(forms, lambda f: F.abs(f["time_period"] - time) <= window)
    keyed = F.transform(forms, lambda f: F.struct(
        F.abs(f["time_period"] - time).alias("gap"),
        f["time_period"].alias("time_period"),
        f["rank"].alias("rank"),
        f["phonetic_representation"].alias("phonetic_representation"),
    ))
    return F.array_min(keyed)


def latest_form(forms: Column | str) -> Column:
    """The form of the latest period (ties: greatest rank); null if none."""
    return F.array_max(F.transform(col(forms), lambda f: F.struct(
        f["time_period"].alias("time_period"),
        f["rank"].alias("rank"),
        f["phonetic_representation"].alias("phonetic_representation"),
    )))
