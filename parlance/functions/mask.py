"""Masking, keyed hashing and redaction, as native column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import fixed_values as fv
from parlance.functions.regex import bind, digits_only, empty_strings, replace_matches, unicode


def mask_cpf(cpf: Column) -> Column:
    """``383.182.856-05`` -> ``***.***.856-05``."""
    digits = digits_only(cpf)
    kept = F.concat(
        F.lit("***.***."), F.substring(digits, 7, 3), F.lit("-"), F.substring(digits, 10, 2)
    )
    return F.when(F.length(digits) == 11, kept).when(
        cpf.isNotNull(), F.lit("***.***.***-**")
    )


def mask_email(email: Column) -> Column:
    """First and last character of the user and the whole domain stay."""
    parts = F.split(email, "@", -1)
    user, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    size = F.length(user)
    hidden = F.when(size <= 2, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(
            F.substring(user, 1, 1), F.repeat(F.lit("*"), size - 2), F.substring(user, -1, 1)
        )
    )
    return F.when(F.size(parts) == 2, F.concat(hidden, F.lit("@"), domain)).when(
        email.isNotNull(), F.lit("***@***.***")
    )


def mask_phone(phone: Column, strip_country: bool = False) -> Column:
    """``(dd) ****-dddd`` from the first two and last four digits.

    A leading country code counts as area code, unless ``strip_country`` removes the 55 of
    numbers with 12 or more digits.
    """
    digits = digits_only(phone)
    if strip_country:
        digits = F.when(
            (F.length(digits) >= 12) & digits.startswith("55"), F.substring(digits, 3, 20)
        ).otherwise(digits)
    kept = F.concat(
        F.lit("("), F.substring(digits, 1, 2), F.lit(") ****-"), F.substring(digits, -4, 4)
    )
    return F.when(F.length(digits) >= 10, kept).when(
        phone.isNotNull(), F.lit("(**) ****-****")
    )


def mask_plate(plate: Column) -> Column:
    """``SYL8V26`` -> ``S**8*26``."""
    clean = F.upper(F.regexp_replace(plate, "[^A-Za-z0-9]", ""))
    kept = F.concat(
        F.substring(clean, 1, 1),
        F.lit("**"),
        F.substring(clean, 4, 1),
        F.lit("*"),
        F.substring(clean, 6, 2),
    )
    return F.when(F.length(clean) == 7, kept).when(plate.isNotNull(), F.lit("***-****"))


def mask_array(values: Column, mask: Callable[[Column], Column]) -> Column:
    """Each element masked; NULL becomes an empty array."""
    return F.transform(F.coalesce(values, empty_strings()), lambda value: mask(value))


@dataclass(frozen=True)
class HashKey:
    """Key of the keyed hash, prepared as the two padded blocks of HMAC-SHA256.

    ``columns`` adds the blocks to a DataFrame through scalar subqueries over a local table, so
    that the key stands in no query plan, log or saved result.
    """

    inner: Column
    outer: Column

    @classmethod
    def prepare(cls, spark: SparkSession, secret: str) -> HashKey:
        if not secret:
            raise ValueError("the hash needs a secret")
        key = secret.encode()
        if len(key) > 64:
            key = hashlib.sha256(key).digest()
        key = key.ljust(64, b"\0")
        pads = [
            (bytearray(b ^ 0x36 for b in key), bytearray(b ^ 0x5C for b in key)),
        ]
        table = spark.createDataFrame(pads, "inner_pad binary, outer_pad binary")
        return cls(table.select("inner_pad").scalar(), table.select("outer_pad").scalar())

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"_inner_pad": self.inner, "_outer_pad": self.outer})

    @staticmethod
    def detach(df: DataFrame) -> DataFrame:
        return df.drop("_inner_pad", "_outer_pad")


def hash_digits(value: Column, length: int = 16) -> Column:
    """HMAC-SHA256 of the digits, first hex characters; needs ``HashKey.attach`` before."""
    digits = F.encode(digits_only(value), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(F.col("_inner_pad"), digits), 256))
    return F.substring(F.sha2(F.concat(F.col("_outer_pad"), inner), 256), 1, length)


def redact_body(text: Column) -> Column:
    """Text with CPFs, then e-mails, then plates replaced by their masked forms."""
    cpf_kept = unicode(r"\b\d{3}\.?\d{3}\.?(\d{3})-?(\d{2})\b")
    # a text without three digits in a row holds no CPF
    no_cpf = F.when(
        text.rlike(unicode(r"\d{3}")), F.regexp_replace(text, cpf_kept, "***.***.$1-$2")
    ).otherwise(text)
    # a text without @ or without two digits in a row holds no e-mail and no plate
    no_email = F.when(
        text.contains("@"), replace_matches(no_cpf, fv.EMAIL, mask_email)
    ).otherwise(no_cpf)
    any_plate = f"(?i)(?:{fv.PLATE_NEW}|{fv.PLATE_OLD})"
    return F.when(
        text.rlike(unicode(r"\d{2}")), replace_matches(no_email, any_plate, mask_plate)
    ).otherwise(no_email)


def redact_rules(
    text: Column, rules: Sequence[tuple[str, str]] = fv.REDACTION_RULES
) -> Column:
    """Text with each rule's matches replaced by ``<REDACTED:NAME>``, in rule order; NULL -> ''.

    Rules with a needle are tried only on texts that hold it; no rule's label adds one.
    """
    whole = F.coalesce(text, F.lit(""))
    result = whole
    for name, pattern in rules:
        marked, label = unicode(pattern), f"<REDACTED:{name}>"
        needle = fv.REDACTION_NEEDLES.get(name)
        if needle is None:
            result = F.regexp_replace(result, marked, label)
        else:
            result = bind(
                result,
                lambda t: F.when(
                    whole.contains(needle), F.regexp_replace(t, marked, label)
                ).otherwise(t),
            )
    return result


def rule_counts(
    df: DataFrame, column: str, rules: Sequence[tuple[str, str]] = fv.REDACTION_RULES
) -> DataFrame:
    """Number of replacements per rule over a text column.

    The texts are redacted once; labels they hold before that do not count.
    """

    def labels(value: str, label: str) -> Column:
        found = F.regexp_count(value, F.lit(label))
        return F.when(F.col(value).contains(label), found).otherwise(0)

    text = F.coalesce(column, F.lit(""))
    both = df.select(text.alias("_text"), redact_rules(text, rules).alias("_redacted"))
    counts = {}
    for name, _ in rules:
        label = f"<REDACTED:{name}>"
        counts[name] = F.sum(labels("_redacted", label) - labels("_text", label))
    totals = both.agg(*[count.alias(name) for name, count in counts.items()])
    pairs = [
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("replacements")) for name in counts
    ]
    return totals.select(F.inline(F.array(*pairs)))


def redact_secrets(text: Column) -> Column:
    """Text with key-like tokens replaced by ``[REDACTED]``."""
    for pattern in fv.SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def redact_error(text: Column, size: int | None = None) -> Column:
    """The whole text redacted. With ``size`` it is cut afterwards, so that no half of a value
    survives the cut."""
    redacted = redact_rules(text)
    return redacted if size is None else F.substring(redacted, 1, size)


def redact_nested(df: DataFrame) -> DataFrame:
    """Every string in the row redacted, inside structs, arrays and map values too; keys stay."""

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(value.isNotNull(), redact_rules(value))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda item: walk(item, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, item: walk(item, kind.valueType))
        if isinstance(kind, T.StructType):
            fields = [walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        return value

    return df.select(*[walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
