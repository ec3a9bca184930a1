"""One expression, two engines: operators are written once as SQL expressions; Spark runs them, DuckDB checks them.

Patterns use the common subset of Java and RE2 (no lookaround, ASCII classes written out), and lists are taken by
functions that give null outside, so that both engines agree value for value.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

_names = itertools.count()


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def text(self, value: str) -> str:
        """A string literal; patterns keep their backslashes."""
        if not self.spark:
            return "'" + value.replace("'", "''") + "'"
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def array(self, values: list[str] | tuple[str, ...]) -> str:
        body = ", ".join(map(self.text, values))
        return f"array({body})" if self.spark else f"[{body}]"

    def items(self, *values: str) -> str:
        body = ", ".join(values)
        return f"array({body})" if self.spark else f"[{body}]"

    def replace(self, x: str, pattern: str, by: str) -> str:
        """All matches replaced; groups in ``by`` are written $1."""
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})" if self.spark else f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace('$', chr(92)))}, 'g')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        """The group of the first match, null without one."""
        return self.nonempty(f"regexp_extract({x}, {self.text(pattern)}, {group})")

    def nonempty(self, x: str) -> str:
        """A text, null if it is empty; Spark's own nullif computes it twice inside of lambdas."""
        return f"get(filter(array({x}), s -> s <> ''), 0)" if self.spark else f"nullif({x}, '')"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def translate(self, x: str, old: str, new: str) -> str:
        return f"translate({x}, {self.text(old)}, {self.text(new)})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.text(pattern)}, -1)" if self.spark else f"regexp_split_to_array({x}, {self.text(pattern)})"

    def split_on(self, x: str, sep: str) -> str:
        # Escaped by one backslash, a single sign is split at without a pattern.
        return f"split({x}, {self.text(chr(92) + sep if len(sep) == 1 and not sep.isalnum() else chr(92) + 'Q' + sep + chr(92) + 'E')}, -1)" if self.spark else f"string_split({x}, {self.text(sep)})"

    def before(self, x: str, phrase: str) -> str:
        """What stands before a phrase's first occurrence, or all."""
        return f"substring_index({x}, {self.text(phrase)}, 1)" if self.spark else f"string_split({x}, {self.text(phrase)})[1]"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, {self.text(sep)})" if self.spark else f"coalesce(array_to_string({x}, {self.text(sep)}), '')"

    def map(self, x: str, name: str, body: str) -> str:
        return f"transform({x}, {name} -> {body})" if self.spark else f"list_transform({x}, lambda {name}: {body})"

    def filter(self, x: str, name: str, body: str) -> str:
        return f"filter({x}, {name} -> {body})" if self.spark else f"list_filter({x}, lambda {name}: {body})"

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def at(self, x: str, index: str) -> str:
        """The element at a place from 1, or null."""
        return f"get({x}, cast({index} as int) - 1)" if self.spark else f"list_extract({x}, ({index})::bigint)"

    def has(self, x: str, value: str) -> str:
        return f"array_contains({x}, {value})" if self.spark else f"list_contains({x}, {value})"

    def among(self, value: str, values: list[str] | tuple[str, ...]) -> str:
        """Whether a text is one of fixed ones; Spark looks it up in a hash set."""
        return f"({value} in ({', '.join(map(self.text, values))}))" if self.spark else self.has(self.array(values), value)

    def any_among(self, x: str, values: list[str] | tuple[str, ...]) -> str:
        """Whether an array of texts without nulls has one of fixed ones."""
        return f"exists({x}, e -> {self.among('e', values)})" if self.spark else self.overlap(x, self.array(values))

    def overlap(self, x: str, y: str) -> str:
        return f"arrays_overlap({x}, {y})" if self.spark else f"list_has_any({x}, {y})"

    def distinct(self, x: str) -> str:
        """Distinct elements in order of their first places."""
        return f"array_distinct({x})" if self.spark else f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"

    def contains(self, x: str, phrase: str) -> str:
        return f"contains({x}, {phrase})"

    def let(self, x: str, body: Callable[[str], str]) -> str:
        """The body over the value of x, which is computed once."""
        name = f"t{next(_names)}"
        return self.at(self.map(self.items(x), name, body(name)), "1")

    def unless_empty(self, x: str, body: Callable[[str], str]) -> str:
        """The body, an array that is empty for an empty text; Spark does not compute it for one."""
        if not self.spark:
            return body(x)
        name = f"t{next(_names)}"
        return f"flatten(transform(filter(array({x}), s -> s <> ''), {name} -> {body(name)}))"

    def map_with(self, x: str, name: str, index: str, body: str) -> str:
        """Elements with their places from 1."""
        return f"transform({x}, ({name}, {index}0) -> {self.bind(f'{index}0 + 1', index, body)})" if self.spark else f"list_transform({x}, lambda {name}, {index}: {body})"

    def bind(self, x: str, name: str, body: str) -> str:
        return self.at(self.map(self.items(x), name, body), "1")

    def fold(self, x: str, start: str, acc: str, item: str, body: str) -> str:
        """An ordered fold over an array, whose state is an array of the elements' kind."""
        if self.spark:
            return f"aggregate({x}, {start}, ({acc}, {item}) -> {body})"
        return f"list_reduce(list_transform({x}, lambda {item}0: [{item}0]), lambda {acc}, {item}1: {self.bind(f'{item}1[1]', item, body)}, {start})"

    def place(self, x: str, phrase: str) -> str:
        """The first place of a phrase in a text from 1, 0 without one."""
        return f"{'instr' if self.spark else 'strpos'}({x}, {phrase})"

    def integer(self, x: str) -> str:
        return f"cast({x} as int)"

    def first_place(self, x: str, name: str, test: str) -> str:
        """The first place from 1 whose element passes, 0 without one."""
        return f"array_position({self.map(x, name, f'coalesce({test}, false)')}, true)" if self.spark else f"coalesce(list_position({self.map(x, name, f'coalesce({test}, false)')}, true), 0)"

    def int(self, x: str) -> str:
        return f"try_cast({x} as int)"

    def pad(self, x: str, n: int) -> str:
        """Zeros to the left up to n characters; longer values stay."""
        return f"case when length({x}) < {n} then lpad({x}, {n}, '0') else {x} end"

    def struct(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def explode(self, x: str) -> str:
        return f"explode({x})" if self.spark else f"unnest({x})"

    def slice(self, x: str, start: str, n: str) -> str:
        return f"slice({x}, {start}, {n})" if self.spark else f"list_slice({x}, {start}, {start} + ({n}) - 1)"

    def concat_arrays(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})" if self.spark else "list_concat(" + ", ".join(xs[:2]) + ")" if len(xs) == 2 else f"list_concat({xs[0]}, {self.concat_arrays(*xs[1:])})"


SPARK, DUCKDB = Dialect(True), Dialect(False)
