"""Names, patterns and limits that results depend on."""

# --- Fixed values -----------------------------------------------------------

FIELDS = (
    "merchant_name",
    "transaction_time",
    "merchant_address",
    "reference_number",
    "total_amount",
    "subtotal_amount",
    "tax_amount",
)
MONEY_FIELDS = ("total_amount", "tax_amount", "subtotal_amount")

# Library of field patterns, in the order in which they are tried.
FIELD_PATTERNS = {
    "merchant_name": [
        r"^\s*([A-Z][A-Z\s&.']{2,})\s*$",
        r"^\s*([A-Z][a-zA-Z\s&.']{2,})\s*$",
        r"^\s*(?:Store|Merchant|Shop|Restaurant|Retail|Vendor):\s*([A-Za-z0-9\s&.'-]+)",
        r"^(?:\*{2,}|\s{2,}|\t+)([A-Za-z0-9\s&.'-]+)(?:\*{2,}|\s{2,}|\t+)$",
    ],
    "transaction_time": [
        r"Date:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"Date:\s*(\d{1,2}\s+[A-Za-z]{3,}\s+\d{2,4})",
        r"(\d{1,2}\s+[A-Za-z]{3,}\s+\d{2,4})",
        r"Time:\s*(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?)",
        r"(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?)",
        r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?)",
        r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})",
        r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}(?::\d{2})?)",
        r"(\d{1,2}\.\d{1,2}\.\d{2,4})",
        r"Transaction\s+(?:Date|Time):\s*([A-Za-z0-9\s/:.-]+)",
    ],
    "merchant_address": [
        r"(?:Address|Location):\s*(.*(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Plaza|Plz|Square|Sq|Highway|Hwy|Route|Rt).*)",
        r"(.*(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Plaza|Plz|Square|Sq|Highway|Hwy|Route|Rt).*)",
        r"(.*(?:\d{5}|\d{5}-\d{4}|\d{4}\s*[A-Z]{2}).*)",
        r"((?:.*,?\s*){1,3}(?:\d{5}|\d{5}-\d{4}|\d{4}\s*[A-Z]{2}))",
        r"([A-Za-z0-9\s]+(?:Store|Branch|Location|Express|Superstore|Market|Shop))",
        r"([A-Za-z0-9\s]+(?:Mall|Centre|Center|Retail Park))",
        r"([A-Za-z\s]+,\s*[A-Za-z\s]+)",
        r"Tel(?:ephone)?:.*?([A-Za-z0-9\s,]+)(?=\n|$)",
        r"(?:store|branch)(?:\s*#|\s*no|\s*number)?:?\s*([A-Za-z0-9\s]+)",
        r"([A-Za-z]+\s+(?:Express|Extra|Metro|Local|Superstore|Supermarket))",
    ],
    "reference_number": [
        r"(?:Order|Receipt|Transaction|Ref|Reference|Invoice)(?:\s*#|\s*No|\s*Number)?:\s*([A-Za-z0-9-]+)",
        r"(?:Order|Receipt|Transaction|Ref|Reference|Invoice)(?:\s*#|\s*No|\s*Number)?:\s*([A-Za-z0-9-]+)",
        r"#\s*([A-Za-z0-9-]{5,})",
        r"([A-Za-z0-9][\w\-]{4,})",
        r"VAT\s*(?:Number|Reg|Registration|No)(?:\s*:|\s+)?\s*([A-Za-z0-9\s-]+)",
        r"Tax\s*(?:ID|Number|Identifier)(?:\s*:|\s+)?\s*([A-Za-z0-9\s-]+)",
        r"(?:Check|Bill)\s*(?:#|No|Number)?(?:\s*:|\s+)?\s*([A-Za-z0-9-]+)",
        r"(?:Terminal|Register|Till)(?:\s*:|\s+)?\s*([A-Za-z0-9-]+)",
        r"Auth(?:orization|orisation)?\s*(?:Code|No|#)?(?:\s*:|\s+)?\s*([A-Za-z0-9-]+)",
        r"(?:Payment|Transaction)\s*ID(?:\s*:|\s+)?\s*([A-Za-z0-9-]+)",
    ],
    "tax_amount": [
        r"(?:Tax|VAT|GST|HST)(?:\s*\(\d+%\))?:\s*(\d+\.\d{2})",
        r"(?:Tax|VAT|GST|HST)(?:\s*\(\d+%\))?(?:\s*:)?\s*(\d+\.\d{2})",
        r"(?:Tax|VAT|GST|HST)\s*\((\d+\.\d{1,2})%\):\s*(\d+\.\d{2})",
        r"(?:Sales\s+Tax|Tax\s+Total):\s*(\d+\.\d{2})",
        r"(?:Tax|VAT|GST|HST)(?:\s+\d+%)?(?:\s*:)?\s*([£$€]?\d+\.\d{2})",
        r"(?:.*Tax.*\n)*.*Tax.*?(\d+\.\d{2})",
        r"(?:VAT|Tax)?\s+Included:\s*(\d+\.\d{2})",
    ],
    "total_amount": [
        r"(?:Total|Amount Due|Grand Total|Balance Due|Pay This Amount):\s*(\d+\.\d{2})",
        r"(?:Total|Amount Due|Grand Total|Balance Due|Pay This Amount)(?:\s*:)?\s*(\d+\.\d{2})",
        r"(\d+\.\d{2})\s*$",
        r"TOTAL\s*(?::)?\s*[£$€]?(\d+\.\d{2})",
        r"(?:Cash|Card|Credit|Debit)\s+(?:Paid|Payment|Tender|Amount):\s*(\d+\.\d{2})",
        r"(?:To Pay|Please Pay|Amount Paid|Paid|Payment)(?:\s*:)?\s*[£$€]?(\d+\.\d{2})",
        r"(?:Total|Amount Due|Grand Total|Balance Due|Pay This Amount)(?:\s*:)?\s*[£$€](\d+\.\d{2})",
    ],
    "subtotal_amount": [
        r"(?:Subtotal|Sub-total|Net):\s*(\d+\.\d{2})",
        r"(?:Subtotal|Sub-total|Net)(?:\s*:)?\s*(\d+\.\d{2})",
        r"(?:Subtotal|Sub-total|Net|Goods)\s+(?:Amount|Value)(?:\s*:)?\s*(\d+\.\d{2})",
        r"(?:Amount|Total)\s+(?:Before|Ex)\s+(?:Tax|VAT)(?:\s*:)?\s*(\d+\.\d{2})",
        r"(?:Items|Basket)\s+(?:Total|Amount)(?:\s*:)?\s*(\d+\.\d{2})",
        r"(?:Subtotal|Sub-total|Net)(?:\s*:)?\s*[£$€](\d+\.\d{2})",
    ],
}

# Library of item patterns with the capture group of each field.
ITEM_PATTERNS = [
    (r"(\d+(?:\.\d+)?)\s+([A-Za-z0-9\s&'.,\-]+?)\s+(?:[£$€])?(\d+\.\d{2})",
     {"quantity": 1, "item_name": 2, "total_price": 3}),
    (r"(\d+(?:\.\d+)?)\s*[xX]\s+([A-Za-z0-9\s&'.,\-]+?)\s+(?:[£$€])?(\d+\.\d{2})",
     {"quantity": 1, "item_name": 2, "total_price": 3}),
    (r"([A-Za-z0-9\s&'.,\-]+?)\s+(\d+(?:\.\d+)?)\s+(?:[£$€])?(\d+\.\d{2})",
     {"item_name": 1, "quantity": 2, "total_price": 3}),
    (r"([A-Za-z0-9\s&'.,\-]+?)\s+(?:[£$€])?(\d+\.\d{2})",
     {"item_name": 1, "total_price": 2, "quantity": 1}),
    (r"([A-Za-z0-9\s&'.,\-]+?)\s+(\d+(?:\.\d+)?)\s+(?:[£$€])?(\d+\.\d{2})\s+(?:[£$€])?(\d+\.\d{2})",
     {"item_name": 1, "quantity": 2, "unit_price": 3, "total_price": 4}),
    (r"(\d+(?:\.\d+)?)\s+([A-Za-z0-9\s&'.,\-]+?)\s+(?:[£$€])?(\d+\.\d{2})\s+(?:[£$€])?(\d+\.\d{2})",
     {"quantity": 1, "item_name": 2, "unit_price": 3, "total_price": 4}),
    (r"(\d+(?:\.\d+)?)\s+(?:Pkg|PKG|pkg)\s+([A-Za-z0-9\s&'.,\-]+?)\s+(?:[£$€])?(\d+\.\d{2})",
     {"quantity": 1, "item_name": 2, "total_price": 3}),
    (r"([A-Za-z0-9\s&'.,\-]+?)\s+(\d+(?:\.\d+)?)\s*(?:kg|g|lb|oz)\s+(?:[£$€])?(\d+\.\d{2})",
     {"item_name": 1, "quantity": 2, "total_price": 3}),
]
# Patterns used when no library pattern covers half of the items.
CUSTOM_QTY_ITEM_PRICE = r".*?(\d+(?:\.\d+)?).*?([A-Za-z0-9\s&\'.,\-]+?).*?(\d+\.\d{2}).*"
CUSTOM_ITEM_PRICE = r".*?([A-Za-z0-9\s&\'.,\-]+?).*?(\d+\.\d{2}).*"

# Misread fixes, applied in this order (three further ones change nothing).
MISREADS = [(r"(\d+)m1", "$1ml"), (r"(\d+)1", "$1l"), (r"\s{2,}", " "), (r"^\s+", ""), (r"\s+$", "")]

# Lines that are noise.
NOISE_SPACED = r"^(.)( (.))+$"
NOISE_REPEATED = r"^([-_.,:;!@#$%^&*()+=~`<>?/\\|])\1{3,}$"
NOISE_SHAPES = [
    r"""^[_\-—–.,:;'"`*]+$""",
    r"^[\\\\/|]+$",
    r"^[^a-zA-Z0-9£$€]{4,}$",
    r"^[a-zA-Z\s]{1,2}$",
    r"^\s*[_\-—–.]{2,}\s*$",
]
SPECIAL_SHARE = 0.4
EDGE_TRIM = r"^[^a-zA-Z0-9£$€]*([a-zA-Z0-9£$€].*[a-zA-Z0-9£$€])[^a-zA-Z0-9£$€]*$"

# Lines that never continue an item name (matched without regard to case).
NOT_CONTINUATION = [
    r"^\s*\d+\.\d{2}\s*$",
    r"^\s*(?:total|subtotal|tax|vat|savings|promotions)[\s:]+",
    r"^\s*$",
    r"^\s*[-=*]+\s*$",
    r"^\s*\d+(?:\s*x)?\s*\d+\.\d{2}",
    r"^\s*[£$€]?\d+\.\d{2}\s*(?:-[£$€]?\d+\.\d{2})?$",
    r"^\s*[£$€]?\d+\.\d{2}\s*each",
    r"^\s*\d+\s+",
    r"^[Cc][Cc]",
]
ITEM_GAP = 3

# The fallback template.
GENERIC_MERCHANT = "Generic"
GENERIC_EXTRACTORS = [
    # field, expected, patterns, line, offset from last item
    ("merchant_name", True, [r"^([A-Z][A-Za-z0-9\s&.']+)$", r"^(.{5,50})$"], 0, None),
    ("transaction_time", True, [
        r"Date[:\s]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})[\s]*\d{1,2}:\d{2}",
        r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\b"], 3, None),
    ("merchant_address", True, [
        r"([A-Za-z0-9\s,.']+,\s*[A-Z]{1,2}\d{1,2}\s*\d[A-Z]{2})",
        r"([A-Za-z0-9\s,.']+,\s*[A-Z]{2}\s*\d{5})"], 1, None),
    ("reference_number", False, [
        r"(?:receipt|order|ref|invoice)[\s#:]*([A-Za-z0-9\-]+)", r"\b(\d{5,})\b"], 4, None),
    ("total_amount", True, [
        r"total\s*[:\s]*[£$€]?(\d+\.\d{2})",
        r"amount\s*[:\s]*[£$€]?(\d+\.\d{2})",
        r"(?:sum|due|pay)[\s:]*[£$€]?(\d+\.\d{2})",
        r"[£$€]?\s*(\d+\.\d{2})\s*$"], None, 3),
    ("tax_amount", False, [
        r"(?:tax|vat|gst)[\s:]*[£$€]?(\d+\.\d{2})",
        r"(?:tax|vat|gst)[\s:]*\d+%[\s:]*[£$€]?(\d+\.\d{2})"], None, 2),
]
GENERIC_ITEM_PATTERNS = [
    (r"(\d+)[xX\s]+(.*?)\s+[£$€]?(\d+\.\d{2})", {"quantity": 1, "item_name": 2, "total_price": 3}),
    (r"([\d.]+)\s+(.*?)\s+[£$€]?(\d+\.\d{2})\s+[£$€]?(\d+\.\d{2})",
     {"quantity": 1, "item_name": 2, "unit_price": 3, "total_price": 4}),
    (r"(.*?)\s+[£$€]?(\d+\.\d{2})", {"item_name": 1, "total_price": 2}),
]
GENERIC_ACCURACY = {
    "merchant_name": 80.0, "transaction_time": 75.0, "merchant_address": 60.0,
    "reference_number": 50.0, "total_amount": 80.0, "tax_amount": 60.0,
}
GENERIC_SUCCESS_RATE = 70.0
DEFAULT_START_LINE = 5

# Matching and learning thresholds.
MERCHANT_THRESHOLD = 70
CANDIDATE_LIMIT = 5
SAME_FIELD_SCORE = 85
ITEM_COVERAGE = 0.5
WORD_OVERLAP = 0.6
KEEP, NEW = 0.7, 0.3

# Job and receipt states.
JOB_STATES = ("pending", "queued", "processing", "completed", "confirmed", "failed", "discarded", "abandoned")
RECEIPT_STATES = ("pending", "approved", "rejected")
FILE_EXTENSIONS = ("jpg", "jpeg", "png", "pdf", "tiff")
FILE_TYPES = ("image/jpeg", "image/png", "application/pdf", "image/tiff")
EXTENSION_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "pdf": "application/pdf", "tiff": "image/tiff", "tif": "image/tiff", "json": "application/json",
}
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
TEMPLATE_FLAGS = ("age_flag", "usage_flag", "override_flag", "extraction_flag", "accuracy_flag")

# Category names of the extraction rules; the keywords come from their one-line descriptions.
CATEGORY_KEYWORDS = [
    ("GROCERY", ["supermarket", "food store"]),
    ("DINING", ["restaurant", "cafe", "food delivery"]),
    ("RETAIL", ["clothing", "electronics", "merchandise"]),
    ("TRANSPORT", ["fuel", "parking", "transport"]),
    ("HEALTHCARE", ["medical", "pharmacy"]),
    ("ENTERTAINMENT", ["movie", "event", "activit"]),
    ("UTILITIES", ["phone", "internet", "electricity"]),
    ("SERVICES", ["professional", "maintenance"]),
]
CURRENCY_CODES = {"£": "GBP", "€": "EUR"}  # "$" has several codes and stays NULL
PAYMENT_NAMES = [("VISA", "visa"), ("MASTERCARD", "mastercard"), ("AMEX", "amex|american express"),
                 ("CARD", "card"), ("CASH", "cash"), ("PAYPAL", "paypal"), ("APPLE PAY", "apple pay")]

# --- End of fixed values ----------------------------------------------------
