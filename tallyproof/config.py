"""What the caller says about a ledger: which column plays which role, how dirt is treated, what is asked."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace
from decimal import Decimal

# Spellings shared with existing policies and reports.
DD_MM = "DD/MM/YYYY"
MM_DD = "MM/DD/YYYY"
BLANK_CURRENCY = "(BLANK)"
TRANSACTION_DATE = "transaction_date"
LATEST = "latest"
INCLUDE_REFUNDS = "include_as_negative"
EXCLUDE_REFUNDS = "exclude"
BLOCK_ANSWER = "block_answer"
BLANK_LABEL = "(blank)"


class RequestError(ValueError):
    """The request cannot be computed as asked; no figure may be shown."""


@dataclass(frozen=True)
class RateColumns:
    currency: str = "currency"
    rate: str = "rate"
    effective: str = "effective_date"
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class RefundColumns:
    key: str = "ref_id"
    amount: str = "ref_amt"
    date: str = "ref_dt"


@dataclass(frozen=True)
class SummaryColumns:
    period: str = "quarter"
    amount: str = "reported"
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mapping:
    """Column roles of one ledger. `order` replaces file order wherever "first" or "last" matters."""

    key: str | None = None
    date: str | None = None
    entity: str | None = None
    amount: str | None = None
    currency: str | None = None
    order: tuple[str, ...] = ()
    unit_multiplier: Decimal = Decimal(1)
    rates: RateColumns = field(default_factory=RateColumns)
    refunds: RefundColumns = field(default_factory=RefundColumns)
    summary: SummaryColumns = field(default_factory=SummaryColumns)

    def measuring(self, metric: str | None) -> Mapping:
        """The same roles with another column as the amount."""
        return replace(self, amount=metric) if metric else self

    def roles(self) -> set[str]:
        return {c for c in (self.key, self.date, self.entity, self.amount, self.currency) if c}


def normalise_code(text: str) -> str:
    """A currency cell in the one spelling that codes are compared in."""
    code = str(text).strip().upper()
    return BLANK_CURRENCY if code in {"", "BLANK", BLANK_CURRENCY} else code


def clean_code_map(answers: dict[str, str]) -> dict[str, str]:
    """Confirmed currencies, both sides normalised; raises on all targets that are no three-letter code."""
    pairs = [(normalise_code(found), normalise_code(means)) for found, means in answers.items()]
    if wrong := sorted({means for _, means in pairs if not re.fullmatch("[A-Z]{3}", means)}):
        raise ValueError("currency codes have three letters, these do not: " + ", ".join(wrong))
    return dict(pairs)


@dataclass(frozen=True)
class Policy:
    date_format: str = DD_MM
    target_currency: str = "INR"
    currency_map: dict[str, str] = field(default_factory=dict)
    conversion_basis: str | None = None
    refunds: str = INCLUDE_REFUNDS
    unsupported_currency: str = "block_and_list"
    conflicting_duplicate: str = "flag_exclude_and_block_if_in_scope"

    def __post_init__(self):
        if self.date_format not in (DD_MM, MM_DD):
            raise ValueError(f"date_format must be {DD_MM} or {MM_DD}")
        if self.conversion_basis not in (None, TRANSACTION_DATE, LATEST):
            raise ValueError(f"conversion_basis must be {TRANSACTION_DATE} or {LATEST}")
        object.__setattr__(self, "currency_map", clean_code_map(self.currency_map or {}))

    @property
    def basis(self) -> str:
        return self.conversion_basis or TRANSACTION_DATE

    @property
    def other_format(self) -> str:
        return MM_DD if self.date_format == DD_MM else DD_MM

    def with_(self, **changes) -> Policy:
        return replace(self, **changes)


@dataclass(frozen=True)
class Request:
    """One question: a sum or a count over an entity / column filter and an inclusive date range.

    `metric` names the column to be added up where that is not the ledger's amount. It then takes the amount's part in every
    rule; refunds are refunds of the amount and are not subtracted from it.
    """

    agg: str = "sum"
    start: dt.date | None = None
    end: dt.date | None = None
    filters: tuple[tuple[str, str], ...] = ()
    entities: tuple[str, ...] = ()
    metric: str | None = None

    def __post_init__(self):
        if self.agg not in ("sum", "count"):
            raise RequestError(f"aggregation {self.agg!r} is not supported")
        if (self.start is None) != (self.end is None) or (self.start and self.start > self.end):
            raise RequestError(f"date range {self.start} - {self.end} is not valid")

    @classmethod
    def between(cls, start: str, end: str, date_format: str = DD_MM, **rest) -> Request:
        """Build a request from slash dates as typed by a person; a date that does not exist is refused."""
        pattern = "%d/%m/%Y" if date_format == DD_MM else "%m/%d/%Y"
        try:
            first, last = (dt.datetime.strptime(t.strip(), pattern).date() for t in (start, end))
        except ValueError as bad:
            raise RequestError(f"date range {start} - {end} is not valid for {date_format}") from bad
        return cls(start=first, end=last, **rest)

    def with_(self, **changes) -> Request:
        return replace(self, **changes)
