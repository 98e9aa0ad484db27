"""Parameters of the registered queries over the driver tables.

The entrants derived from the driver tables have slots 1-25 and classes
1995-2001, so the cut-offs are scaled to them: the "lottery" is slots 1-14,
the "first round" slots 1-20, and the as-of date makes classes up to 1997
mature (four years before 2001).
"""

LOTTERY = 14
FIRST_ROUND = 20
FOCUS_SLOT = 2
AS_OF = "2001-12-31"
MATURITY_YEARS = 4
FLOAT_DIGITS = 6       # float results are rounded so engines agree on the last bits
REPORT_SLOTS = None    # all slots of the exemplars table
DISPLAY_SLOTS = list(range(1, LOTTERY + 1))  # slots of the displayed report
PLACEHOLDER = "images/placeholder.jpg"
LISTING_PAGE = 2
LISTING_DEEP = 400     # a page far from the first
LISTING_SIZE = 25
PAGE_ORDERS = 500      # order keys of a rendered page
CATEGORY = "fr"
COMPARE_FIRST = 5      # "the first five" slots of the comparisons
