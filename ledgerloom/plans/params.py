"""Constants bound in ``queries()`` and in the oracle SQL."""

import datetime as _dt

AS_OF = _dt.date(2001, 6, 30)           # replaces "today"
TRADE_FROM = _dt.date(1998, 1, 1)
TRADE_TO = _dt.date(1998, 12, 31)
TRADE_YEAR, TRADE_MONTH = 1998, 3
STAFF_FROM = _dt.date(2024, 1, 1)
STAFF_TO = _dt.date(2024, 1, 31)
STAFF_YEAR, STAFF_MONTH = 2024, 1
EMPTY_YEAR, EMPTY_MONTH = 2024, 2       # a month with no ledger rows
GALLERY_ID = 3                          # odd ids are galleries
WAREHOUSE_ID = 2
ORDER_SEARCH = "00012"
ITEM_SEARCH = "ring"
LEDGER_SEARCH = "PARTY 1"
TARGET = 600000
DASHBOARD_TARGET = 50000
PAGE, PER_PAGE = 3, 50
