"""Small array helpers.

A page is one row, so its parts (blocks, units, posts) are arrays inside that
row.  Working on them in place needs no shuffle, whatever the number of pages
and however often one URL occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Items per block in running_sum: keeps the copying below linear in practice.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def running_sum(values: Column) -> Column:
    """Inclusive running sum of an ``array<int>``.

    Summed per block of ``BLOCK`` items, then shifted by the sum of the blocks
    before it, so a very long array does not cost quadratic copying.
    """

    def grow(items: Column, start: Column) -> Column:
        sums = F.reduce(
            items,
            F.array(start),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        )
        return F.slice(sums, F.lit(2), F.size(items))

    def by_blocks(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
        return let(
            F.transform(starts, lambda s: F.slice(items, s, F.lit(BLOCK))),
            lambda blocks: F.flatten(
                F.zip_with(
                    blocks,
                    F.concat(
                        F.array(F.lit(0)),
                        grow(
                            F.transform(
                                F.slice(blocks, F.lit(1), F.size(blocks) - 1),
                                lambda b: F.reduce(b, F.lit(0), lambda a, x: a + x),
                            ),
                            F.lit(0),
                        ),
                    ),
                    grow,
                )
            ),
        )

    return let(
        values,
        lambda v: F.when(F.size(v) <= BLOCK, grow(v, F.lit(0))).otherwise(by_blocks(v)),
    )


def split_before(
    items: Column, is_start: Callable[[Column], Column], keep_head: bool = True
) -> Column:
    """Cut an array into runs, each beginning at an item where ``is_start`` holds.

    ``keep_head`` keeps the (possibly empty) run before the first start as run 0.
    """

    def cut(arr: Column) -> Column:
        starts = F.filter(
            F.transform(arr, lambda x, i: F.when(is_start(x), i + 1)), lambda i: i.isNotNull()
        )
        if keep_head:
            starts = F.concat(F.array(F.lit(1)), starts)
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: F.slice(
                    arr, start, F.coalesce(F.get(s, k + 1), F.size(arr) + 1) - start
                ),
            ),
        )

    return let(items, cut)


def split_after(items: Column, is_end: Callable[[Column], Column]) -> Column:
    """Cut an array into runs, each closing with an item where ``is_end`` holds."""

    def cut(arr: Column) -> Column:
        ends = F.filter(
            F.transform(arr, lambda x, i: F.when(is_end(x), i + 1)), lambda i: i.isNotNull()
        )
        return let(
            F.concat(F.array(F.lit(0)), ends),
            lambda e: F.transform(
                e,
                lambda end, k: F.slice(
                    arr, end + 1, F.coalesce(F.get(e, k + 1), F.size(arr)) - end
                ),
            ),
        )

    return let(items, cut)


def filled(value: Column) -> Column:
    """The value; NULL when it is an empty string."""
    return let(value, lambda v: F.when(v != "", v))


def nonblank(value: Column) -> Column:
    """Trimmed value; NULL when missing or only white space."""
    return filled(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def first_nonblank(*values: Column) -> Column:
    """First value of the chain that is neither missing nor blank."""
    return F.coalesce(*[nonblank(v) for v in values])
