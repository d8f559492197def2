"""Fixed values that results depend on: category labels, band edges and
thresholds. Kept together, in natural order, as plain text."""

# --- fixed values -----------------------------------------------------------
SALE = 0                     # refund_flag of a sale
REFUND = 1                   # refund_flag of a refund
UNKNOWN_DEVICE = "Unknown"   # replacement for a missing device_type
PRODUCT_EVENTS = ["purchase", "add_to_cart"]   # events that need a product_id

EVENT_VIEW = "view"
EVENT_CLICK = "click"
EVENT_CART = "add_to_cart"
EVENT_PURCHASE = "purchase"
EVENT_BOUNCE = "bounce"

PURCHASE_BANDS = [           # (label, low, high); high None = open ended
    ("1 purchase", 1, 1),
    ("2-3 purchases", 2, 3),
    ("4-5 purchases", 4, 5),
    ("6+ purchases", None, None),
]
AGE_BANDS = [
    ("18-24", 18, 24),
    ("25-34", 25, 34),
    ("35-44", 35, 44),
    ("45-54", 45, 54),
    ("55+", None, None),
]

PREMIUM = "Premium"
STANDARD = "Standard"
DISCOUNTED = "Discounted"
FULL_PRICE = "Full Price"
TOP_5_PCT = "Top 5%"
BOTTOM_95_PCT = "Bottom 95%"
EXPOSED = "Exposed"
NOT_EXPOSED = "Not Exposed"

RFM_SEGMENTS = [             # (label, minimum r+f+m score); last is the rest
    ("Champions", 10),
    ("Loyal", 7),
    ("Potential", 5),
    ("At Risk", None),
]
RFM_TILES = 4
REVENUE_TILES = 20
RFM_AS_OF = "2023-12-31"     # default recency anchor
TOP_N = 10

FUNNEL_STEPS = [             # (label, stage in, stage out)
    ("view → click", "view_stage", "click_stage"),
    ("click → add_to_cart", "click_stage", "cart_stage"),
    ("add_to_cart → purchase", "cart_stage", "purchase_stage"),
]
# ---------------------------------------------------------------------------
