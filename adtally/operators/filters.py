"""Filters of the sales report. All of them only narrow the set of reported sites.

Conditions on attributes choose sites in the dimension, and the facts are narrowed to these
before they are summed. As all filters narrow, their order does not matter. An empty field
(no text, no entries) is no filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.operators.managers import listed
from adtally.operators.spine import MARKS
from adtally.operators.trigram_index import containing
from adtally.sources.tables import SellTables

SITES, USERS, LOOKBACK = "sites", "users", "lookback"


@dataclass(frozen=True)
class SpineFilter:
    """One filter, given by some of:

    ``condition`` on the attributes of sites that ``needs`` names; with ``keeps_unknown`` facts of
    sites outside the dimension pass. ``narrow_sites`` narrows the sites of the dimension, and
    ``site_ids`` gives the ids to keep. ``unless_empty`` is a frame without whose rows the
    filter keeps everything. ``row_condition`` is put to the sums, ``fact_condition`` to the facts.
    """

    needs: frozenset[str] = frozenset()
    condition: Column | None = None
    keeps_unknown: bool = False
    narrow_sites: Callable[[DataFrame, SellTables], DataFrame] | None = None
    site_ids: Callable[[SellTables], DataFrame] | None = None
    unless_empty: DataFrame | None = None
    row_condition: Column | None = None
    fact_condition: Column | None = None


def _predicate(condition: Column, *needs: str) -> SpineFilter:
    return SpineFilter(frozenset(needs), condition)


def _keep_all() -> SpineFilter:
    return SpineFilter()


def by_country(country_id: int) -> SpineFilter:
    return _predicate(F.col("country_id") == country_id, SITES)


def by_subsystem(subsystem_id: int) -> SpineFilter:
    return _predicate(F.col("subsystem_id") == subsystem_id, USERS)


def by_managers(managers: Iterable[int] | DataFrame | None) -> SpineFilter:
    """Sites whose user belongs to one of the managers.

    ``managers`` is a list of ids or a one-column frame such as
    :func:`adtally.operators.managers.managers_of_group` gives. None, an empty list and a frame
    without rows are no filter.
    """
    scope = managers if isinstance(managers, DataFrame) else None
    wanted = [] if scope is not None else list(managers or ())
    if scope is None and not wanted:
        return _keep_all()

    def narrow(sites: DataFrame, tables: SellTables) -> DataFrame:
        links = tables.user_managers
        if scope is None:
            links = links.where(F.col("manager_id").isin(wanted))
        else:
            links = links.join(listed(scope), "manager_id", "left_semi")
        return sites.join(links.select("user_id").distinct(), "user_id", "left_semi")

    return SpineFilter(frozenset({SITES}), narrow_sites=narrow, unless_empty=None if scope is None else listed(scope))


def by_exchanger(choice: str) -> SpineFilter:
    """``exchanger``, ``not_exchanger`` or an empty string for no filter."""
    if choice == "":
        return _keep_all()
    if choice == "exchanger":
        return _predicate(F.col("is_exchanger"), USERS)
    if choice == "not_exchanger":
        return _predicate(~F.col("is_exchanger"), USERS)
    raise ValueError(f"unknown exchanger filter {choice!r}")


def by_user(wanted: str, exact: bool = False) -> SpineFilter:
    """By user id if the text is a number, else by a part of the e-mail (whole if ``exact``)."""
    text = wanted.strip()
    if not text:
        return _keep_all()
    if text.isdecimal():
        return _predicate(F.col("user_id") == int(text), SITES)
    email = F.lower("email")
    match = email == text.lower() if exact else email.contains(text.lower())
    return _predicate(match, USERS)


def by_user_indexed(wanted: str, index: DataFrame) -> SpineFilter:
    """``by_user`` for a part of the e-mail, with the candidates from a trigram index of the users' e-mails."""
    text = wanted.strip()
    if not text or text.isdecimal():
        return by_user(text)

    def narrow(sites: DataFrame, tables: SellTables) -> DataFrame:
        users = containing(tables.users, "id", "email", index, text)
        return sites.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")

    return SpineFilter(frozenset({SITES}), narrow_sites=narrow)


def by_network(prefix: str) -> SpineFilter:
    """Users of a partner network carry its prefix in front of their e-mail."""
    return _predicate(F.col("email").startswith(prefix), USERS) if prefix else _keep_all()


def by_site(wanted: str) -> SpineFilter:
    """By site id if the text is a number, else by a part of the URL."""
    text = wanted.strip()
    if not text:
        return _keep_all()
    if text.isdecimal():
        return SpineFilter(fact_condition=F.col("site_id") == int(text))
    return _predicate(F.lower("site_url").contains(text.lower()), SITES)


def by_site_indexed(wanted: str, index: DataFrame) -> SpineFilter:
    """``by_site`` for a part of the URL, with the candidates from a trigram index of the sites' URLs."""
    text = wanted.strip()
    if not text or text.isdecimal():
        return by_site(text)

    def ids(tables: SellTables) -> DataFrame:
        return containing(tables.sites, "id", "url", index, text).select(F.col("id").alias("site_id"))

    return SpineFilter(site_ids=ids)


def by_marks(marks: Mapping[str, str], allowed: Iterable[str] = MARKS) -> SpineFilter:
    """Equality on every allowed mark that has a value, of one row of the user's marks."""
    wanted = {name: marks[name] for name in allowed if marks.get(name)}
    if not wanted:
        return _keep_all()

    def narrow(sites: DataFrame, tables: SellTables) -> DataFrame:
        marked = tables.user_marks
        for name, value in wanted.items():
            marked = marked.where(F.col(name) == value)
        return sites.join(marked.select("user_id"), "user_id", "left_semi")

    return SpineFilter(frozenset({SITES}), narrow_sites=narrow)


def by_profit_types(profit_types: Iterable[str]) -> SpineFilter:
    wanted = list(profit_types)
    return _predicate(F.col("profit_type").isin(wanted), SITES) if wanted else _keep_all()


def by_publisher_status(status: str) -> SpineFilter:
    """``new`` sites had no day rows in the two months before the report month, ``current`` had.

    The lookback rows are counted in the same pass over the facts as the report's sums.
    """
    if status == "new":
        return SpineFilter(frozenset({LOOKBACK}), row_condition=F.col("lookback_rows") == 0)
    if status == "current":
        return SpineFilter(frozenset({LOOKBACK}), row_condition=F.col("lookback_rows") > 0)
    raise ValueError(f"unknown publisher status {status!r}")


def by_min_teaser_rating(ratings: Iterable[int | None]) -> SpineFilter:
    """Any of the listed ratings; ``None`` in the list stands for sites without one."""
    chosen = list(ratings)
    if not chosen:
        return _keep_all()
    rating = F.col("min_teaser_rating")
    condition = rating.isin([value for value in chosen if value is not None])
    if None in chosen:
        condition = condition | rating.isNull()
    return SpineFilter(frozenset({SITES}), condition, keeps_unknown=None in chosen)


def by_category(category_ids: Iterable[str]) -> SpineFilter:
    """Sites in any of the categories; a site may have many categories."""
    wanted = list(category_ids)
    if not wanted:
        return _keep_all()

    def ids(tables: SellTables) -> DataFrame:
        return tables.site_categories.where(F.col("category_id").isin(wanted)).select("site_id")

    return SpineFilter(site_ids=ids)
