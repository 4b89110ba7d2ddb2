"""Spellings that differ between Spark SQL and the SQL that checks it."""

from __future__ import annotations

import re


def doubles(text: str) -> str:
    """Decimal literals as double literals, which both engines read alike."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text)


class Spark:
    #: A ticket's five items follow from its id, so that its row needs neither a row for each item nor a join.
    by_row = True

    def written(self, text: str) -> str:
        """A plan's text with EACH(a, b, ...) as a row for each and decimals as doubles."""
        return doubles(re.sub(r"EACH\(([^()]*)\)", self.each(), text))

    def each(self) -> str:
        return r"explode(array(\1))"

    def u(self, text: str) -> str:
        """A uniform number from [0, 1) that depends on a text only."""
        return f"(cast(conv(substr(md5({text}), 1, 13), 16, 10) as double) / 4503599627370496.0)"

    def seq(self, low: str, high: str) -> str:
        return f"explode(sequence({low}, {high}))"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def days(self, late: str, early: str) -> str:
        return f"datediff({late}, {early})"

    def weekday(self, day: str) -> str:
        return f"weekday({day})"

    def percentile(self, x: str, p: str) -> str:
        return f"percentile({x}, {p})"

    def even(self, x: str) -> str:
        return f"bround({x})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def text(self, day: str) -> str:
        return f"date_format({day}, 'yyyy-MM-dd')"

    def gcd(self, a: str, b: str) -> str:
        """Euclid's algorithm as a fold: two numbers below 2**31 need at most 45 steps."""
        step = "(p, i) -> if(p.b = 0, p, named_struct('a', p.b, 'b', p.a % p.b))"
        return f"aggregate(sequence(1, 46), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), {step}, p -> p.a)"

    def matches(self, text: str, pattern: str) -> str:
        return f"explode(regexp_extract_all({text}, '{pattern}', 1))"

    def total(self, x: str) -> str:
        """A sum of longs that may pass 63 bits."""
        return f"sum(cast({x} as decimal(38, 0)))"

    def bits(self, x: str) -> str:
        return f"bit_count({x})"


class Duck(Spark):
    by_row = False

    def each(self) -> str:
        return r"unnest([\1])"

    def u(self, text: str) -> str:
        return f"(cast(cast('0x' || substr(md5({text}), 1, 13) as bigint) as double) / 4503599627370496.0)"

    def seq(self, low: str, high: str) -> str:
        return f"unnest(range({low}, {high} + 1))"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def days(self, late: str, early: str) -> str:
        return f"date_diff('day', {early}, {late})"

    def weekday(self, day: str) -> str:
        return f"(isodow({day}) - 1)"

    def percentile(self, x: str, p: str) -> str:
        return f"quantile_cont({x}, {p})"

    def even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def text(self, day: str) -> str:
        return f"strftime({day}, '%Y-%m-%d')"

    def gcd(self, a: str, b: str) -> str:
        return f"cast(gcd({a}, {b}) as bigint)"

    def total(self, x: str) -> str:
        return f"sum({x})"

    def matches(self, text: str, pattern: str) -> str:
        return f"unnest(regexp_extract_all({text}, '{pattern}', 1))"
