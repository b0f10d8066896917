"""Entity extraction from message text, as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.functions.regex import (
    digits_only, empty_strings, find_all, find_first, unicode,
)


def has_digits(text: Column, in_a_row: int) -> Column:
    """Cheap test that spares most texts the patterns that need a run of digits."""
    return text.rlike(unicode(rf"\d{{{in_a_row}}}"))


def extract_cpf(text: Column) -> Column:
    """Tax numbers (CPF) with or without punctuation."""
    return F.when(has_digits(text, 3), find_all(text, fv.CPF, 1)).otherwise(empty_strings())


def valid_cpf(cpf: Column) -> Column:
    """True for 11 digits, not all the same, whose two check digits fit."""
    digits = digits_only(cpf)
    numbers = F.transform(F.split(digits, ""), lambda d: d.try_cast("int"))

    def check_digit_fits(place: int) -> Column:
        weights = F.array(*[F.lit(w) for w in range(place, 1, -1)])
        weighted = F.zip_with(F.slice(numbers, 1, place - 1), weights, lambda n, w: n * w)
        total = F.aggregate(weighted, F.lit(0), lambda acc, x: acc + x)
        return F.get(numbers, F.lit(place - 1)) == (total * 10 % 11) % 10

    well_formed = (F.length(digits) == 11) & ~digits.rlike(r"^(.)\1{10}$")
    return F.when(
        well_formed, F.coalesce(check_digit_fits(10) & check_digit_fits(11), F.lit(False))
    ).when(cpf.isNotNull(), F.lit(False))


def extract_email(text: Column) -> Column:
    """E-mail addresses; text without an @ skips the pattern."""
    return F.when(text.contains("@"), find_all(text, fv.EMAIL)).otherwise(empty_strings())


def extract_phone(text: Column) -> Column:
    """Brazilian phone numbers, with optional country and area code."""
    return F.when(has_digits(text, 4), find_all(text, fv.PHONE)).otherwise(empty_strings())


def extract_plate(text: Column) -> Column:
    """Distinct licence plates in upper case, new and old format, sorted."""
    upper = F.upper(text)
    both = F.concat(find_all(upper, fv.PLATE_NEW, 1), find_all(upper, fv.PLATE_OLD, 1))
    return F.when(has_digits(text, 2), F.array_sort(F.array_distinct(both))).otherwise(
        empty_strings()
    )


def extract_cep(text: Column) -> Column:
    """Post codes (CEP)."""
    return F.when(has_digits(text, 5), find_all(text, fv.CEP, 1)).otherwise(empty_strings())


def literal_start(pattern: str) -> str:
    """Plain text that every match of a pattern begins with; empty if that is not clear."""
    if "|" in pattern:
        return ""
    plain = re.match("[a-z ]*", pattern).group()
    quantified = pattern[len(plain) : len(plain) + 1] in ("*", "?", "{")
    return plain[:-1] if quantified else plain


def extract_competitor(
    text: Column, competitors: Sequence[tuple[str, str]] = fv.COMPETITORS
) -> Column:
    """Names of the insurers mentioned, in the order of the list."""
    return competitors_in(F.lower(text), competitors)


def competitors_in(
    lower: Column, competitors: Sequence[tuple[str, str]] = fv.COMPETITORS
) -> Column:
    """The same of a lower-case text.

    A substring test goes before each pattern, as most texts mention none.
    """
    named = [
        F.when(lower.contains(literal_start(p)) & lower.rlike(unicode(p)), F.lit(name))
        for p, name in competitors
    ]
    return F.array_compact(F.array(*named))


def extract_price(text: Column) -> Column:
    """Amounts in R$ as doubles."""

    def amount(found: Column) -> Column:
        plain = F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return plain.try_cast("double")

    prices = F.transform(find_all(text, fv.PRICE, 1), amount)
    return F.when(text.contains("R$"), F.array_compact(prices)).otherwise(
        F.array().cast("array<double>")
    )


def extract_vehicle(
    text: Column, brand_of: dict[str, str] = fv.MODEL_BRANDS
) -> Column:
    """Struct of brand, model and year: leftmost known model and first year 1980-2029."""
    any_model = "|".join(re.escape(model) for model in brand_of)
    brands = F.create_map(*[F.lit(x) for x in chain.from_iterable(brand_of.items())])
    model = find_first(F.lower(text), any_model)
    return F.struct(
        F.when(model.isNotNull(), F.element_at(brands, model)).alias("brand"),
        model.alias("model"),
        find_first(text, fv.MODEL_YEAR).alias("year"),
    )
