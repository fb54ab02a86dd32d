"""Partial masks of single values, by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import col, let, strip

REDACTED = "[REDACTED]"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _first(value: Column) -> Column:
    return F.when(F.length(value) > 0, F.left(value, F.lit(1))).otherwise("*")


def mask_email(value: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    domain = F.substring(value, F.instr(value, "@") + 1, F.length(value))
    tld = F.substring_index(domain, ".", -1)
    head = F.left(domain, F.length(domain) - F.length(tld) - 1)
    shown = F.when(F.contains(domain, F.lit(".")), F.concat(_first(head), F.lit("***."), tld)).otherwise("***")
    return F.when(F.contains(value, F.lit("@")), F.concat(_first(local), F.lit("***@"), shown)).otherwise(REDACTED)


def mask_phone(value: Column) -> Column:
    def own(d: Column) -> Column:
        n = F.length(d)
        return F.when(d.startswith("91") & (n == 12), F.substring(d, 3, 10)).when(d.startswith("0") & (n == 11), F.substring(d, 2, 10)).otherwise(d)

    return F.concat(F.left(let(digits(value), own), F.lit(4)), F.lit("******"))


def mask_card(value: Column) -> Column:
    return F.concat(F.lit("**** **** **** "), F.right(digits(value), F.lit(4)))


def mask_aadhaar(value: Column) -> Column:
    return F.concat(F.lit("**** **** "), F.right(digits(value), F.lit(4)))


def mask_pan(value: Column) -> Column:
    v = strip(value)
    tail = F.when(F.length(v) >= 4, F.right(v, F.lit(2))).otherwise(F.right(v, F.lit(1)))
    return F.when(F.length(v) < 3, REDACTED).otherwise(F.concat(F.left(v, F.lit(2)), F.lit("***"), tail))


def mask_person(value: Column) -> Column:
    v = strip(value)
    words = F.split(v, r"(?U)\s+")
    one = F.concat(F.left(v, F.lit(1)), F.lit("****"))
    more = F.concat(words[0], F.lit(" "), F.left(F.element_at(words, -1), F.lit(1)), F.lit("****"))
    return F.when(v == "", REDACTED).when(F.size(words) == 1, one).otherwise(more)


def mask_date(value: Column) -> Column:
    year = F.regexp_extract(value, r"\b(?:19|20)\d{2}\b", 0)
    return F.concat(F.lit("**/**/"), F.when(year == "", "****").otherwise(year))


def mask_account(value: Column) -> Column:
    return let(digits(value), lambda d: F.concat(F.repeat(F.lit("*"), F.greatest(F.length(d) - 4, F.lit(4))), F.right(d, F.lit(4))))


def mask_location(value: Column) -> Column:
    parts = F.split(value, ",", -1)
    return F.when(F.size(parts) >= 2, F.concat(F.lit("[STREET REDACTED], "), strip(F.element_at(parts, -1)))).otherwise(REDACTED)


MASKS = {
    "EMAIL_ADDRESS": mask_email, "IN_PHONE": mask_phone, "PHONE_NUMBER": mask_phone, "CREDIT_CARD": mask_card, "AADHAAR": mask_aadhaar,
    "PAN": mask_pan, "PERSON": mask_person, "DATE_TIME": mask_date, "ACCOUNT_NUMBER": mask_account, "LOCATION": mask_location,
}


def partial_mask(value: Column | str, entity_type: Column | str) -> Column:
    """The mask of the value's type; other types are redacted."""
    v, kind, out = col(value), col(entity_type), F.lit(REDACTED)
    for name, mask in MASKS.items():
        out = F.when(kind == name, mask(v)).otherwise(out)
    return out


def token(entity_type: Column, n: Column) -> Column:
    """<<TYPE_007>>; numbers over three digits keep them all."""
    text = n.cast("string")
    return F.concat(F.lit("<<"), entity_type, F.lit("_"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0")), F.lit(">>"))
