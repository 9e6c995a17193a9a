"""Classifiers of bookings: outcome, settlement, cancellation, airport, alerts, income."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that the feeds use.
COMPLETED = ["completed", "finished", "complete", "closed", "delivered"]
NOT_COMPLETED = ["client_did_not_show", "driver_did_not_respond", "driver_rejected", "rejected", "offer_rejected", "expired", "failed", "no_show"]
SETTLEMENT = {
    "cash": ["cash", "cash-driver", "cash-supervisor"],
    "card": ["pos-driver", "pos-supervisor", "braintree", "zaakpay", "kcp_pg", "card", "credit_card"],
    "wallet": ["apple_pay", "google_pay", "paypal", "alipay2", "digital", "wallet", "cashless", "in_app"],
    "on_account": ["room-charge", "hotel-charge", "company", "corporate", "invoice", "business"],
    "salary": ["posted-for-salary", "salary"],
    "complimentary": ["foc-complimentary", "foc", "complimentary"],
    "off_platform": ["offline"],
    "adjustment": ["derivative"],
}
DROPPED = ["driver_cancelled", "driver_cancelled_after_accept"]
DECLINED = ["driver_did_not_respond", "driver_rejected", "offer_rejected"]
RIDER = ["rider_cancelled", "client_cancelled", "client_did_not_show"]
HELD_BY_DRIVER = ["cash", "cash-driver"]
RECEIVABLE = ["room-charge", "hotel-charge", "posted-for-salary"]
DEVICE_FAULT = "power|battery|tamper|disconnect|gps"
# The airports' names in Latin and Arabic letters and their codes; only Dubai's
# has numbered terminals.
AIRPORTS = [
    {"icao": "OMDW", "name": "al maktoum", "arabic": "آل مكتوم", "iata": "dwc", "numbered": False},
    {"icao": "OMDB", "name": "dubai", "arabic": "دبي", "iata": "dxb", "numbered": True},
]


def bare_status(status: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(status)), "^optional_ride_", "")


def outcome(status: Column) -> Column:
    """completed, not_completed, other; null where no status is known."""
    bare = bare_status(status)
    lost = F.lower(status).like("%cancel%") | bare.isin(NOT_COMPLETED)
    return F.when(status.isNull(), None).when(bare.isin(COMPLETED), "completed").when(lost, "not_completed").otherwise("other")


def completed(status: Column) -> Column:
    return bare_status(status).isin(COMPLETED)


def settlement_class(payment: Column) -> Column:
    word = F.lower(payment)
    ladder = F.when(payment.isNull() | (F.trim(payment) == ""), None)
    ladder = reduce(lambda c, kind: c.when(word.isin(SETTLEMENT[kind]), kind), SETTLEMENT, ladder)
    return ladder.otherwise("other")


def cancelled_by(outcome_: Column, status: Column) -> Column:
    """Who ended a booking that was not completed; null for any other."""
    bare = bare_status(status)
    return F.when(~outcome_.eqNullSafe(F.lit("not_completed")), None).when(bare.isin(DROPPED + DECLINED), "driver").when(bare.isin(RIDER), "rider").otherwise("unattributed")


def device_fault(alert_type: Column) -> Column:
    return F.coalesce(alert_type.rlike(f"(?i){DEVICE_FAULT}"), F.lit(False))


def address_parts(address: Column) -> Column:
    """An address in lower case without apostrophes, its parts between ` | `, brackets kept."""
    bare = F.regexp_replace(F.lower(address), "['’]", "")
    parts = F.regexp_replace(bare, r"\s*(,|\s-|-\s)\s*", " | ")
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(parts, r"[^\p{L}\p{N}|()]+", " "), r"[()]", " $0 "), F.lit(" "))


def airport_of(address: Column) -> Column:
    """OMDW, OMDB or null for an address.

    It is at an airport if it names one (its name, perhaps `international`, and `airport`,
    but no road, zone or building called after that; its code in brackets; or its code and
    `terminal` in one part), or a numbered terminal and a place inside one. It is only beside
    one if it says so, if it is a hotel's or free zone's, if it is in a street and names no
    terminal, or if its terminal is one of ships, buses or taxis.
    """
    parts = address_parts(address)
    says = lambda pattern: parts.rlike(pattern)
    terminal = says(r" terminal ?[1-3] ")
    street = says(r" (st|street|rd|road|roundabout) ") & ~terminal
    beside = says(r" (opp|oppo|opposite|near|behind|beside|next to) ") | says(r"\b(hotel|inn|free ?zone|dafza)\b") | says(r" (cruise|ferry|bus|taxi) ") | street
    found = F.when(beside, None)
    for a in AIRPORTS:
        named = rf" {a['name']} (international |intl |int l )?(airport(?! (road|rd|free|view))|air +\|)"
        at = says(named) | says(rf" مطار {a['arabic']} ") | says(rf"\( +{a['iata']} +\)") | says(rf" {a['iata']} [^|]*terminal ")
        if a["numbered"]:
            at |= terminal & says(r" (airport|مطار|arrivals?|departures?|customs|concourse|meeting point) ")
        found = found.when(at, a["icao"])
    return found


def net_fare(earnings: Column, tip: Column, taxes: Column, net: Column) -> Column:
    """What the driver earned for the ride: earnings less tip and taxes, else the filed net."""
    return F.coalesce(earnings - F.coalesce(tip, F.lit(0)) - F.coalesce(taxes, F.lit(0)), net)


def income_basis(statement: Column, coverage: Column, payouts: Column, payout_share: Column, n_payouts: Column, fare_share: Column, n_fares: Column) -> Column:
    """Which record of income holds: statement, payouts, fares, in that order, as far as
    each covers four fifths of its days or bookings.
    """
    return (
        F.when(statement > 0, F.when(coverage.isNull() | (coverage >= 0.8), "statement").otherwise("partial_statement"))
        .when((n_payouts > 0) & (payouts == 0), "zero_payout")
        .when((n_payouts > 0) & (payout_share >= 0.8), "payout")
        .when((n_payouts == 0) & (fare_share >= 0.8), "fares")
        .when(n_payouts > 0, "partial_payout")
        .when(n_fares > 0, "partial_fares")
        .otherwise("none")
    )


def document_status(days_left: Column) -> Column:
    return (
        F.when(days_left.isNull(), "missing")
        .when(days_left < 0, "expired")
        .when(days_left <= 30, "d30")
        .when(days_left <= 45, "d45")
        .when(days_left <= 90, "d90")
        .otherwise("ok")
    )
