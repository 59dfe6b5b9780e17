"""Reproducible labelled anomalies: corrupt a share of rows in one of five ways.

Shared rule: a row is hit with probability `ratio`; one attribute is chosen uniformly; its status is
set to suspect (2) when not null and its value is changed when not null. All other cells stay.

Randomness is a pure function of the row key: one md5 digest of (key columns, seed, mode) gives four
independent 32-bit uniform draws (hit, attribute, magnitude U, sign). Which rows and attributes are hit
therefore does not depend on partitioning, task retries or recomputation (the stddev mode's magnitude
can differ in the last bits, as partial variances merge in partition order). The whole operator is one
projection (plus, for the stddev mode, one per-entity aggregate joined back).
"""

from __future__ import annotations

import random
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.exprs import (hex_word, md5_hex, negate_int, row_key, row_max, row_min, trunc_to_int, unit_draw,
                               word_below, word_bucket)
from ..schema import DEFAULT_SCHEMA, ObsSchema, require_columns, spare_names
from .entity import entity_stddev, join_entity_stats
from .joins import COUNT_COL
from .moments import entity_stddev_exact

SLOT_HIT, SLOT_ATTR, SLOT_U, SLOT_SIGN = 0, 1, 2, 3


@dataclass
class Draws:
    hit: Column
    attr: Column
    u: Column
    low_side: Column  # the sign/coin draw: "first branch" when true


def draws(key_cols, seed: int, mode: str, ratio: float, n_attrs: int) -> Draws:
    """hit = draw0 < ratio, attribute = floor(draw1 * n), U = draw2, low side = draw3 < 0.5.

    Comparisons run on the digest's hex text (exact); the one hex-to-number conversion (U) is
    evaluated for hit rows only.
    """
    digest = md5_hex(key_cols, seed, mode)
    hit = word_below(hex_word(digest, SLOT_HIT), float(ratio))
    return Draws(
        hit=hit,
        attr=word_bucket(hex_word(digest, SLOT_ATTR), n_attrs),
        u=F.when(hit, unit_draw(digest, SLOT_U)),
        low_side=word_below(hex_word(digest, SLOT_SIGN), 0.5),
    )


def with_draws(df: DataFrame, dr: Draws, extra: dict | None = None) -> tuple[DataFrame, Draws]:
    """Materialise the draws (and other per-row helpers) once in a lower projection.

    Expressions inside CASE branches escape common-subexpression elimination; referencing these
    columns instead keeps the hex-to-number conversions at four per row. CollapseProject does not
    inline a non-trivial expression that is referenced several times, so the split survives.
    """
    names = spare_names(df, "hit", "attr", "u", "low")
    cols = [e.alias(n) for n, e in zip(names, (dr.hit, dr.attr, dr.u, dr.low_side), strict=True)]
    cols += [e.alias(n) for n, e in (extra or {}).items()]
    out = df.select("*", *cols)
    return out, Draws(*[F.col(n) for n in names])


def _is_int(dt) -> bool:
    return isinstance(dt, T.IntegerType)


def _is_double(dt) -> bool:
    return isinstance(dt, T.DoubleType)


def _suspect(df: DataFrame, col: str) -> Column:
    return F.lit(C.STATUS_SUSPECT).cast(df.schema[col].dataType)


@dataclass
class SuspectInjector:
    """Configuration of the injectors: change size `magnitude`, share of hit rows `ratio`.

    `key_cols` tell rows apart; rows with equal keys are hit together. Without them every row draws by all its
    columns and its place in the scan. `exact` takes the deviations of `stddev` from exact sums, so that a rerun over
    another partitioning gives the same bits (`moments.py`); without it their last bits may differ."""

    magnitude: float = C.DEFAULT_MAGNITUDE
    ratio: float = C.DEFAULT_RATIO
    schema: ObsSchema = DEFAULT_SCHEMA
    key_cols: tuple | None = None
    exact: bool = False

    def with_magnitude(self, magnitude: float) -> "SuspectInjector":
        return replace(self, magnitude=magnitude)

    def with_ratio(self, ratio: float) -> "SuspectInjector":
        return replace(self, ratio=ratio)

    # -- helpers -----------------------------------------------------------------------------
    def _keys(self, df: DataFrame) -> list:
        if not self.key_cols:
            return row_key(df)
        require_columns(df, self.key_cols, "key column")
        return list(self.key_cols)

    @staticmethod
    def _seed(seed):
        return random.SystemRandom().randrange(-(2 ** 31), 2 ** 31) if seed is None else int(seed)

    def _per_attribute(self, df: DataFrame, columns, attributes, dr: Draws, value_rule, extra_guard=None,
                       status_guard=None) -> DataFrame:
        """Project `columns` (the input's, without helpers); the chosen attribute's status/value get the mode's rule."""
        sch = self.schema
        targets = {}
        for j, a in enumerate(attributes):
            sel = dr.hit & (dr.attr == F.lit(j))
            if extra_guard is not None:
                sel = sel & extra_guard
            targets[sch.status_col(a)] = ("status", sel)
            targets[sch.value_col(a)] = ("value", sel)
        out = []
        for f in (df.schema[name] for name in columns):
            c = F.col(f"`{f.name}`")
            if f.name not in targets:
                out.append(c)
                continue
            kind, sel = targets[f.name]
            if kind == "status":
                guard = sel & c.isNotNull()
                if status_guard is not None:
                    guard = guard & status_guard
                out.append(F.when(guard, _suspect(df, f.name)).otherwise(c).alias(f.name))
            else:
                new = value_rule(f, c)
                if new is None:
                    out.append(c)
                else:
                    out.append(F.when(sel & c.isNotNull(), new).otherwise(c).alias(f.name))
        return df.select(*out)

    # -- modes -------------------------------------------------------------------------------
    def stddev(self, df: DataFrame, attributes, seed: int | None = None) -> DataFrame:
        """value ± magnitude·(1+U)·stddev(entity, attribute); int values truncated toward zero.

        Entities lacking a stddev for any listed attribute (fewer than two values) stay unchanged.
        """
        attributes = list(attributes)
        seed = self._seed(seed)
        sch = self.schema
        deviations = entity_stddev_exact if self.exact else entity_stddev
        stats = deviations(df, attributes, sch, require_all=True, with_count=True)
        if not attributes:
            return df
        names = spare_names(df, *[f"sd_{a}" for a in attributes])
        sd = {sch.value_col(a): n for a, n in zip(attributes, names, strict=True)}
        stats = stats.select(sch.id_col, COUNT_COL, *[F.col(f"sd_{v}").alias(n) for v, n in sd.items()])
        dr = draws(self._keys(df), seed, "stddev", self.ratio, len(attributes))
        drawn, dr = with_draws(df, dr)
        joined = join_entity_stats(drawn, stats, sch, how="left")
        m = float(self.magnitude)
        sign = F.when(dr.low_side, F.lit(m)).otherwise(F.lit(-m))

        def rule(f, c):
            dev = (F.lit(1.0) + dr.u) * F.col(sd[f.name]) * sign
            if _is_int(f.dataType):
                return trunc_to_int(c.cast("double") + dev)
            if _is_double(f.dataType):
                return c + dev
            return None

        return self._per_attribute(joined, df.columns, attributes, dr, rule, extra_guard=F.col(names[0]).isNotNull())

    def zeroes(self, df: DataFrame, attributes, seed: int | None = None) -> DataFrame:
        """int -> 0, double -> 0.0 (other types unchanged, status still set)."""
        attributes = list(attributes)
        dr = draws(self._keys(df), self._seed(seed), "zeroes", self.ratio, len(attributes))
        drawn, dr = with_draws(df, dr)

        def rule(f, c):
            if _is_int(f.dataType):
                return F.lit(0).cast("int")
            if _is_double(f.dataType):
                return F.lit(0.0)
            return None

        return self._per_attribute(drawn, df.columns, attributes, dr, rule)

    def negatives(self, df: DataFrame, attributes, seed: int | None = None) -> DataFrame:
        """-value for int (MIN_INT stays itself) and double."""
        attributes = list(attributes)
        dr = draws(self._keys(df), self._seed(seed), "negatives", self.ratio, len(attributes))
        drawn, dr = with_draws(df, dr)

        def rule(f, c):
            if _is_int(f.dataType):
                return negate_int(c)
            if _is_double(f.dataType):
                return -c
            return None

        return self._per_attribute(drawn, df.columns, attributes, dr, rule)

    def hilo(self, df: DataFrame, seed: int | None = None, attributes=C.HILO_ATTRIBUTES,
             high: str = C.HILO_HIGH, low: str = C.HILO_LOW, skip_degenerate: bool = False) -> DataFrame:
        """Push one price outside the row's [lo, hi] range of all listed prices (d = hi - lo):
        high -> lo - d + d·U·0.9·2·M, low -> lo + d + d·U·0.9·2·M, others below lo or above hi by
        d·(0.1 + U·0.9·M). A row with no price is unchanged; only double values change."""
        attributes = list(attributes)
        sch = self.schema
        vcols = [sch.value_col(a) for a in attributes]
        require_columns(df, vcols, "price column")
        dr = draws(self._keys(df), self._seed(seed), "hilo", self.ratio, len(attributes))
        m = float(self.magnitude)
        lo_name, hi_name = spare_names(df, "lo", "hi")
        drawn, dr = with_draws(df, dr, {lo_name: row_min(vcols), hi_name: row_max(vcols)})
        lo, hi = F.col(lo_name), F.col(hi_name)
        d = hi - lo
        spread_up = d * dr.u * F.lit(0.9) * F.lit(2.0) * F.lit(m)
        outside = d * (F.lit(0.1) + dr.u * F.lit(0.9) * F.lit(m))
        other = F.when(dr.low_side, lo - outside).otherwise(hi + outside)
        any_value = lo.isNotNull()
        guard = any_value if not skip_degenerate else (any_value & (hi != lo))

        def new_value(a):
            if a == high:
                return (lo - d) + spread_up
            if a == low:
                return (lo + d) + spread_up
            return other

        values = {sch.value_col(a): new_value(a) for a in attributes}

        def rule(f, c):
            if not _is_double(f.dataType):
                return None
            return values[f.name]

        return self._per_attribute(drawn, df.columns, attributes, dr, rule, extra_guard=guard)

    def ask_bid_mid(self, df: DataFrame, seed: int | None = None, attributes=C.SPREAD_ATTRIBUTES) -> DataFrame:
        """Move one of ask/bid/mid by ±M·(0.1 + 0.9·U)·(hi - lo); the status is not set when hi = lo."""
        attributes = list(attributes)
        sch = self.schema
        vcols = [sch.value_col(a) for a in attributes]
        require_columns(df, vcols, "price column")
        dr = draws(self._keys(df), self._seed(seed), "askbidmid", self.ratio, len(attributes))
        m = float(self.magnitude)
        lo_name, hi_name = spare_names(df, "lo", "hi")
        drawn, dr = with_draws(df, dr, {lo_name: row_min(vcols), hi_name: row_max(vcols)})
        lo, hi = F.col(lo_name), F.col(hi_name)
        shift = (F.lit(0.1) + dr.u * F.lit(0.9)) * (hi - lo) * F.when(dr.low_side, F.lit(-m)).otherwise(F.lit(m))

        def rule(f, c):
            if not _is_double(f.dataType):
                return None
            return c + shift

        return self._per_attribute(drawn, df.columns, attributes, dr, rule, extra_guard=lo.isNotNull(),
                                   status_guard=(hi != lo))
