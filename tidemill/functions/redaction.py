"""Secrets in log frames: values under telling names are blanked, at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SECRET = ("password", "passwd", "secret", "token", "credential", "api_key", "license_key")
BLANK = "***REDACTED***"


def _secret(name: str, words: tuple[str, ...], allowed: tuple[str, ...]) -> bool:
    return name.lower() not in allowed and any(w in name.lower() for w in words)


def _plain(t: T.DataType) -> bool:
    """Whether nothing below the type has a name."""
    return not isinstance(t, (T.StructType, T.MapType)) and not (isinstance(t, T.ArrayType) and not _plain(t.elementType))


def _blank(c: Column, t: T.DataType) -> Column:
    return F.when(c.isNotNull(), F.lit(BLANK)) if isinstance(t, T.StringType) else F.lit(None).cast(t)


def _walk(c: Column, t: T.DataType, words: tuple[str, ...], allowed: tuple[str, ...]) -> Column:
    if _plain(t):
        return c
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _walk(x, t.elementType, words, allowed))
    if isinstance(t, T.StructType):
        parts = [_blank(c.getField(f.name), f.dataType) if _secret(f.name, words, allowed) else _walk(c.getField(f.name), f.dataType, words, allowed) for f in t]
        return F.when(c.isNotNull(), F.struct(*(p.alias(f.name) for p, f in zip(parts, t))))
    if not isinstance(t.keyType, T.StringType):
        return F.transform_values(c, lambda _, v: _walk(v, t.valueType, words, allowed))
    telling = lambda k: ~F.lower(k).isin(*allowed, "") & F.greatest(F.lit(False), *(F.contains(F.lower(k), F.lit(w)) for w in words))
    return F.transform_values(c, lambda k, v: F.when(telling(k), _blank(v, t.valueType)).otherwise(_walk(v, t.valueType, words, allowed)))


def redact(df: DataFrame, words: tuple[str, ...] = SECRET, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Values of columns, struct fields and map keys whose lower-cased name holds one of ``words``, blanked.

    Strings become a fixed mark and other types null; nulls stay null.  Names in ``allowed`` are left alone.  The schema
    says where to look, so the plan is one projection.
    """
    words, allowed = tuple(w.lower() for w in words), tuple(a.lower() for a in allowed)
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return df.select(*((_blank if _secret(f.name, words, allowed) else lambda c, t: _walk(c, t, words, allowed))(quoted(f.name), f.dataType).alias(f.name) for f in df.schema))
