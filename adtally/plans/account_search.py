"""Search over the four account types with filters, counts, pages and totals.

One frame holds the accounts of all types, so a search is one filtered pass instead of one
query per type.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.operators import paging
from adtally.operators.managers import of_managers, scope_or_previous

TYPES = ("agent", "buyer", "seller", "exchanger")
MARKS = ("source", "campaign", "medium", "ad")
# Filters a search knows; any other key is dropped.
KNOWN = ("email", "subsystem", "site", "src_id", "country", "webmoney", "crm_status") + MARKS
# Found by a part of the value; all other filters need the whole value.
BY_PART = ("email", "site")

ITEMS_OF_ONE_TYPE = 50
ITEMS_PER_TYPE = 100


def merged_filters(common: Mapping[str, str], marks: Mapping[str, str]) -> dict[str, str]:
    """Common filters and marks in one mapping; a mark wins over an equal key."""
    return {key: value for key, value in {**common, **marks}.items() if key in KNOWN}


def is_empty(value: str | None) -> bool:
    """Whether a field is no filter: without a text, or ``0``."""
    return value is None or value in ("", "0")


@dataclass(frozen=True)
class ManagerScope:
    """Whose accounts are searched: ``all``, ``my``, ``my_group`` or ``manager``.

    ``group`` is a one-column frame of the managers of the person's group and subgroups.
    """

    choice: str
    own_id: int
    picked_id: int | None = None
    group: DataFrame | None = None


@dataclass(frozen=True)
class AccountSearch:
    accounts: DataFrame
    filters: Mapping[str, str]
    scope: ManagerScope
    user_type: str | None = None

    def _has(self, *keys: str) -> bool:
        return not all(is_empty(self.filters.get(key)) for key in keys)

    def searched_types(self) -> list[str]:
        """Types worth searching: some filters exclude a type, a chosen type all others."""
        chosen = [self.user_type] if self.user_type else list(TYPES)
        searched = []
        for kind in chosen:
            if kind == "agent":
                fits = not self._has("site", "src_id", "subsystem", "crm_status")
            elif kind == "buyer":
                fits = not self._has("site", "src_id", "subsystem")
            elif kind == "seller":
                identifying = self._has("email", "site", "src_id", "country", *MARKS)
                fits = bool(self.user_type) or not self._has("subsystem") or identifying
            else:
                fits = kind == "exchanger"
            if fits:
                searched.append(kind)
        return searched

    def manager_choice(self) -> str:
        """``all`` without a filter that identifies an account means one's own accounts."""
        identifying = self._has("email", "site", "src_id", "webmoney", *MARKS)
        if self.scope.choice == "all" and not identifying:
            return "my"
        return self.scope.choice

    def matches(self) -> DataFrame:
        """All accounts found. A search without any filter finds nothing."""
        if not self.filters:
            return self.accounts.limit(0)
        found = self.accounts.where(F.col("user_type").isin(self.searched_types()))
        for key, value in self.filters.items():
            if not is_empty(value):
                found = found.where(_matches(key, value))
        return self._in_scope(found)

    def _in_scope(self, found: DataFrame) -> DataFrame:
        choice = self.manager_choice()
        own = F.col("manager_id") == self.scope.own_id
        if choice == "my":
            return found.where(own)
        if choice == "manager":
            return found.where(F.col("manager_id") == self.scope.picked_id) if self.scope.picked_id else found
        if choice == "my_group":
            # An empty group leaves one's own accounts.
            mine = found.sparkSession.range(1).select(F.lit(self.scope.own_id).cast("long"))
            return of_managers(found, scope_or_previous(self.scope.group, mine))
        return found

    def facets(self) -> DataFrame:
        """Number of accounts found and their balance, per type."""
        return self.matches().groupBy("user_type").agg(
            F.count("*").alias("accounts"), F.expr("coalesce(sum(balance), 0) AS balance")
        )

    def page(self, page: int = 1, order: str = "email", descending: bool = False) -> DataFrame:
        """A page of the chosen type, or the first accounts by e-mail of every type."""
        found = self.matches()
        if self.user_type:
            return paging.page_of(found, order, descending, page, ITEMS_OF_ONE_TYPE)
        by_email = [F.col("email").asc_nulls_last(), F.col("id")]
        return paging.first_per_group(found, "user_type", by_email, ITEMS_PER_TYPE)

    def totals(self) -> DataFrame:
        """Sums over the whole selection with its page count.

        Shown only for a chosen type: for agents from one page on, for others from two.
        """
        if not self.user_type:
            return self.page_counts().limit(0)
        least = 1 if self.user_type == "agent" else 2
        return self.page_counts().where(F.col("pages") >= least)

    def page_counts(self) -> DataFrame:
        """The facets with the number of pages of each type."""
        pages = paging.page_count(F.col("accounts"), ITEMS_OF_ONE_TYPE)
        return self.facets().withColumn("pages", pages)


def _matches(key: str, value: str) -> Column:
    if key in BY_PART:
        return F.lower(key).contains(value.strip().lower())
    return F.col(key) == value
