"""Value patterns and word lists used by cleaning and profiling."""

# Value patterns, tried in this order.
VALUE_PATTERNS = [
    ("email", r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"),
    ("phone", r"^[\+]?[(]?[0-9]{3}[)]?[\-\s\.]?[0-9]{3}[\-\s\.]?[0-9]{4,6}$"),
    ("url", r"^(https?://|www\.)\S+"),
    ("zip_code", r"^\d{5}(-\d{4})?$"),
    ("ip_address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("currency", r"^[€$£¥₹]?\s*-?[\d,]+\.?\d*\s*[€$£¥₹]?$"),
    ("percentage", r"^-?\d+\.?\d*\s*%$"),
]
CURRENCY = dict(VALUE_PATTERNS)["currency"]
PERCENT = dict(VALUE_PATTERNS)["percentage"]

# Date shapes of the format check.
DATE_SHAPES = [
    ("%Y-%m-%d", r"^\d{4}-\d{2}-\d{2}$"), ("%d/%m/%Y", r"^\d{2}/\d{2}/\d{4}$"), ("%m/%d/%Y", r"^\d{2}/\d{2}/\d{4}$"),
    ("%d.%m.%Y", r"^\d{2}\.\d{2}\.\d{4}$"), ("%Y%m%d", r"^\d{8}$"),
]

# Patterns of protected columns.
SEMANTIC_EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
SEMANTIC_PHONE = r"^(?!(?:19|20)\d{2}-\d{2}-\d{2}$)\+?[\d\s\-().]{7,20}$"
SEMANTIC_ZIP = r"(?i)^\d{5}(-\d{4})?$|^[A-Z]\d[A-Z]\s?\d[A-Z]\d$"
SEMANTIC_IP = r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)$"

# Texts that stand for a missing value.
PLACEHOLDERS = [
    "n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "nat", "-", "--", "---", "?", "??", "unknown", "undefined",
    "missing", "not available", "not applicable", "not provided", "not specified", "#n/a", "#null!", "empty", "blank",
    ".", "..", "...",
]

# Words for true and false.
TRUE_WORDS = ["yes", "y", "true", "t", "1", "on", "oui", "si", "ja", "да"]
FALSE_WORDS = ["no", "n", "false", "f", "0", "off", "non", "nein", "нет"]

_Y, _M, _D, _NAME = r"\d{4}", r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])", r"[A-Za-z]{3,9}"

# Date formats in order of precedence, each with the shape a text must have before it is parsed.
DATE_FORMATS = [
    ("yyyy-M-d", f"^{_Y}-{_M}-{_D}$"), ("d/M/yyyy", f"^{_D}/{_M}/{_Y}$"), ("M/d/yyyy", f"^{_M}/{_D}/{_Y}$"),
    ("d-M-yyyy", f"^{_D}-{_M}-{_Y}$"), ("M-d-yyyy", f"^{_M}-{_D}-{_Y}$"), ("yyyy/M/d", f"^{_Y}/{_M}/{_D}$"),
    ("d.M.yyyy", f"^{_D}[.]{_M}[.]{_Y}$"), ("M.d.yyyy", f"^{_M}[.]{_D}[.]{_Y}$"), ("MMMM d, yyyy", f"^{_NAME} {_D}, {_Y}$"),
    ("d MMMM yyyy", f"^{_D} {_NAME} {_Y}$"), ("MMM d, yyyy", f"^{_NAME} {_D}, {_Y}$"), ("d MMM yyyy", f"^{_D} {_NAME} {_Y}$"),
    ("yyyyMMdd", r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"),
]

# Name words of semantic columns.
NAME_WORDS = {
    "email": ["email", "e_mail", "mail"],
    "phone": ["phone", "mobile", "tel", "fax", "cell", "contact"],
    "postal": ["zip", "postal", "postcode", "zipcode", "post_code"],
    "sku": ["sku", "upc", "barcode", "item_no", "product_code", "part_no", "item_code"],
    "account_number": ["account", "acct", "member", "customer_id", "user_id", "employee_id"],
    "id": ["id", "uuid", "guid", "key", "pk", "_id", "ref", "identifier"],
    "revenue": [
        "revenue", "price", "amount", "value", "cost", "salary", "income", "sales", "profit", "spend", "fee", "charge",
        "wage",
    ],
}
# Semantic kinds whose columns are never retyped, and name parts of columns whose outliers are kept.
PROTECTED = ["id", "phone", "postal", "sku", "account_number", "email", "ip_address"]
PRESERVE_OUTLIERS = "(revenue|price|amount|value|cost|salary|income|sales|profit|spend|fee|charge)"
