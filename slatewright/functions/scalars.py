"""Scalar functions as Column expressions."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000.0
MICROS_PER_DAY = 86_400_000_000.0


def exponential_decay(age: Column, half_life: float) -> Column:
    """Half-life decay of a non-negative age."""
    return F.exp(-(F.ln(F.lit(2.0)) * age / F.lit(float(half_life))))


def exploration(user: Column, item: Column) -> Column:
    """The first 64 bits of SHA-256(user, zero byte, item) over 2**64."""
    digest = F.sha2(F.concat(user.cast("binary"), F.lit(b"\0"), item.cast("binary")), 256)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long").cast("double")
    # The upper half times 2**32 is exact, so the sum is rounded once, as the whole would be.
    return (half(1) * F.lit(4294967296.0) + half(9)) / F.lit(18446744073709551616.0)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def lookup(weights: Column, key: Column) -> Column:
    """A map's value, 0 where the key or the map is absent."""
    return F.coalesce(F.try_element_at(weights, key), F.lit(0.0))


def topic_interest(weights: Column, topics: Column) -> Column:
    """Mean signed weight of the topics, moved from [-1, 1] to [0, 1]; 0 without topics."""
    total = F.aggregate(topics, F.lit(0.0), lambda a, t: a + lookup(weights, t))
    return F.when(F.size(topics) == 0, F.lit(0.0)).otherwise(clamp((total / F.size(topics) + 1.0) / 2.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def sigmoid(z: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Full case folding, from Python's own tables: characters that fold to one, what they
    fold to, and those that fold to several."""
    changed = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c}
    single = [c for c, to in changed.items() if len(to) == 1]
    return "".join(single), "".join(changed[c] for c in single), {c: to for c, to in changed.items() if len(to) > 1}


@lru_cache(maxsize=1)
def _blanks() -> str:
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def casefold(text: Column) -> Column:
    """Full Unicode case folding: texts with only ASCII by ``lower``; others character by
    character, those that fold to several by a literal map."""
    of, to, several = _foldings()
    one = F.translate(text, of, to)
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    some = "[" + "".join(several) + "]"
    return F.when(~text.rlike(r"[^\x00-\x7F]"), F.lower(text)).when(one.rlike(some), spelt).otherwise(one)


def strip(text: Column) -> Column:
    """Without white space, of any kind, at the ends."""
    return F.trim(text, F.lit(_blanks()))


def normalize_topics(topics: Column) -> Column:
    """Stripped, case-folded, without empties, each once in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(topics, lambda t: casefold(strip(t))), lambda t: t != ""))


@lru_cache(maxsize=1)
def _runs() -> str:
    """Letters, digits, and what is neither but folds to one."""
    odd = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if not c.isalnum() and c.casefold() != c and any(x.isalpha() for x in c.casefold()))
    return rf"[\p{{L}}\p{{N}}{re.escape(odd)}]+"


def runs(text: Column) -> Column:
    """Runs that tokens are made of, as they stand: what lies between does not fold to a
    letter or digit, so each can be folded by itself."""
    return F.regexp_extract_all(text, F.lit(_runs()), F.lit(0))


def folded(run: Column) -> Column:
    """Tokens of one run: itself, unless folding makes a mark of a letter's part."""
    return F.when(~run.rlike(r"[^\x00-\x7F]"), F.array(F.lower(run))).otherwise(F.regexp_extract_all(casefold(run), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, case-folded.  Runs are folded, not texts: few need more
    than lower case."""
    return F.flatten(F.transform(runs(text), folded))


def term_weight(count: Column) -> Column:
    return 1.0 + F.ln(count)


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.ln((1.0 + n_docs) / (1.0 + df)) + 1.0


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, n = successes / trials, trials.cast("double")
    z2 = z * z
    middle, margin = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    return F.greatest(F.lit(0.0), (middle - margin) / scale), F.least(F.lit(1.0), (middle + margin) / scale)


def expected_random_hit_rate(items: Column, k: Column) -> Column:
    return F.when(items > 0, F.least(k, items) / items).otherwise(F.lit(0.0))


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def is_identifier(c: Column, longest: int = 256) -> Column:
    """Non-empty, without white space at the ends, printable and not too long.  The blank
    is the only separator that is printable."""
    return c.isNotNull() & (strip(c) == c) & F.length(c).between(1, longest) & ~c.rlike(r"[\p{C}[\p{Z}&&[^ ]]]")


def is_unit(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)


def zoned_timestamp(text: Column) -> Column:
    """ISO-8601 with a zone; null without one."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def utc_text(ts: Column) -> Column:
    """UTC text with microseconds only where there are any, in any session's zone."""
    at = F.unix_micros(ts)
    second = ((at - F.pmod(at, F.lit(1_000_000))) / 1_000_000).cast("long")
    day = (second - F.pmod(second, F.lit(86_400))) / 86_400
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    of_day = F.pmod(second, F.lit(86_400))
    clock = F.concat_ws(":", two(F.floor(of_day / 3600)), two(F.floor(of_day / 60) % 60), two(of_day % 60))
    whole = F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), clock)
    micros = F.pmod(at, F.lit(1_000_000))
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def behavior_timestamp(text: Column, offset: str = "+00:00") -> Column:
    """US-format local time at a fixed offset, as an instant: the offset is part of what is
    parsed, so the session's zone has no say."""
    return F.to_timestamp(F.concat(text, F.lit(" " + fixed_offset(offset))), "M/d/yyyy h:mm:ss a xxxxx")


def fixed_offset(offset: str | float) -> str:
    """An offset from UTC, as text or in hours: whole seconds, at most 14 hours each way."""
    if isinstance(offset, str):
        found = re.fullmatch(r"([+-])(\d\d):([0-5]\d)(?::([0-5]\d))?", offset)
        if not found:
            raise ValueError(f"no UTC offset: {offset}")
        seconds = (int(found[2]) * 3600 + int(found[3]) * 60 + int(found[4] or 0)) * (-1 if found[1] == "-" else 1)
    else:
        if isinstance(offset, bool) or not -14 <= offset <= 14 or not (offset * 3600).is_integer():
            raise ValueError("an offset is whole seconds, at most 14 hours from UTC")
        seconds = int(offset * 3600)
    if abs(seconds) > 14 * 3600:
        raise ValueError("an offset is at most 14 hours from UTC")
    minutes, rest = divmod(abs(seconds), 60)
    return f"{'-' if seconds < 0 else '+'}{minutes // 60:02d}:{minutes % 60:02d}" + (f":{rest:02d}" if rest else "")


def instant_us(c: Column, kind: str, zone: str) -> Column:
    """Microseconds of a timestamp column; one without a zone is UTC, whatever the session's."""
    if kind == "timestamp" or zone in ("UTC", "Etc/UTC", "Z", "GMT"):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_micros(F.to_timestamp(F.concat(c.cast("string"), F.lit("+00:00"))))


def split_candidate(token: Column) -> tuple[Column, Column]:
    """An ``id-label`` token, split from the right; (id, clicked)."""
    pattern = "^(.*)-([01])$"
    return F.regexp_extract(token, pattern, 1), F.regexp_extract(token, pattern, 2) == "1"
