"""Patterns, labels, scores and limits that results depend on. They are data, given in their natural order."""

from __future__ import annotations

#: (entity, name, score, regex), in evaluation order; the order breaks ties between spans of equal start.
PATTERNS: list[tuple[str, str, float, str]] = [
    ("AADHAAR", "aadhaar_spaced", 0.95, r"\b[2-9]\d{3}\s\d{4}\s\d{4}\b"),
    ("AADHAAR", "aadhaar_dashed", 0.95, r"\b[2-9]\d{3}-\d{4}-\d{4}\b"),
    ("AADHAAR", "aadhaar_dotted", 0.90, r"\b[2-9]\d{3}\.\d{4}\.\d{4}\b"),
    ("AADHAAR", "aadhaar_slashed", 0.90, r"\b[2-9]\d{3}/\d{4}/\d{4}\b"),
    ("AADHAAR", "aadhaar_plain", 0.75, r"\b[2-9]\d{11}\b"),
    ("PAN", "pan_standard", 0.95, r"\b[A-Z]{3}[A-Z][A-Z]\d{4}[A-Z]\b"),
    ("IN_PHONE", "in_phone_plus91", 0.95, r"(?:\+91[\s\-]?)[6-9]\d{9}\b"),
    ("IN_PHONE", "in_phone_0prefix", 0.85, r"\b0[6-9]\d{9}\b"),
    ("IN_PHONE", "in_phone_bare", 0.75, r"\b[6-9]\d{9}\b"),
    ("IN_PHONE", "in_phone_split_5_5", 0.60, r"\b[6-9]\d{4}[\s\-]\d{5}\b"),
    ("IN_PHONE", "in_phone_split_4_6", 0.60, r"\b[6-9]\d{3}[\s\-]\d{6}\b"),
    ("IN_PHONE", "in_phone_split_3_7", 0.60, r"\b[6-9]\d{2}[\s\-]\d{7}\b"),
    ("UPI", "upi_vpa", 0.95, r"\b[\w.\-+]+@(?:oksbi|okaxis|okicici|okhdfcbank|ybl|ibl|axl|apl|waicici|wahdfc|paytm|upi|rbl|aubank|icici|sbi|hdfc|axis|kotak|boi|pnb|idbi|fbl|ucobank)\b"),
    ("IFSC", "ifsc_standard", 0.95, r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("PASSPORT", "passport_in", 0.75, r"\b[A-Z][1-9]\d{6}\b"),
    ("AADHAAR_VID", "aadhaar_vid_spaced", 0.80, r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b"),
    ("AADHAAR_VID", "aadhaar_vid_dashed", 0.80, r"\b\d{4}-\d{4}-\d{4}-\d{4}\b"),
    ("AADHAAR_VID", "aadhaar_vid_plain", 0.70, r"\b\d{16}\b"),
    ("CVV", "cvv_3digit", 0.40, r"\b\d{3}\b"),
    ("CVV", "cvv_4digit", 0.40, r"\b\d{4}\b"),
    ("ACCOUNT_NUMBER", "account_9to18_digits", 0.65, r"\b\d{9,18}\b"),
    ("BIOMETRIC", "biometric_fp_hash", 0.99, r"\bfp_hash_[A-Za-z0-9_\-]{8,}\b"),
    ("BIOMETRIC", "biometric_face_tmp", 0.99, r"\bface_tmp_[A-Za-z0-9_\-]{8,}\b"),
    ("BIOMETRIC", "biometric_hex_hash", 0.85, r"\b[0-9a-f]{32}(?:[0-9a-f]{32})?\b"),
    ("DEVICE_ID", "device_android", 0.95, r"\bandroid-[0-9a-fA-F]{8,}\b"),
    ("DEVICE_ID", "device_ios", 0.95, r"\bios-[0-9a-fA-F]{8,}\b"),
    ("DEVICE_ID", "device_uuid", 0.75, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"),
    ("EMAIL_ADDRESS", "std_email", 0.90, r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("IP_ADDRESS", "std_ip", 0.85, r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("CREDIT_CARD", "std_cc", 0.85, r"\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
]

#: Types that the first 27 patterns find.
CUSTOM_TYPES = ("AADHAAR", "PAN", "IN_PHONE", "UPI", "IFSC", "PASSPORT", "AADHAAR_VID", "CVV", "ACCOUNT_NUMBER", "BIOMETRIC", "DEVICE_ID")
ALL_TYPES = (*CUSTOM_TYPES, "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "LOCATION", "DATE_TIME", "URL")

#: Label to type.
LABELS: dict[str, str] = {
    "aadhaar": "AADHAAR", "aadhar": "AADHAAR", "uid": "AADHAAR", "uidai": "AADHAAR",
    "pan": "PAN", "permanent account": "PAN",
    "mobile": "IN_PHONE", "phone": "IN_PHONE", "ph": "IN_PHONE", "mob": "IN_PHONE", "contact": "IN_PHONE", "cell": "IN_PHONE",
    "email": "EMAIL_ADDRESS", "mail": "EMAIL_ADDRESS", "e-mail": "EMAIL_ADDRESS",
    "address": "LOCATION", "addr": "LOCATION", "residence": "LOCATION",
    "dob": "DATE_TIME", "date of birth": "DATE_TIME", "born": "DATE_TIME", "birth date": "DATE_TIME",
    "account": "ACCOUNT_NUMBER", "a/c": "ACCOUNT_NUMBER", "acct": "ACCOUNT_NUMBER",
    "ifsc": "IFSC", "upi": "UPI", "vpa": "UPI", "passport": "PASSPORT", "pp no": "PASSPORT",
    "card": "CREDIT_CARD", "credit card": "CREDIT_CARD", "debit card": "CREDIT_CARD",
    "name": "PERSON", "full name": "PERSON", "customer name": "PERSON", "father": "PERSON", "mother": "PERSON", "spouse": "PERSON",
    "cvv": "CVV", "expiry": "EXPIRY", "ip": "IP_ADDRESS", "device": "DEVICE_ID", "fingerprint": "BIOMETRIC", "face": "BIOMETRIC",
}

#: Words near a match that speak for its type.
CONTEXT_WORDS: dict[str, list[str]] = {
    "AADHAAR": ["aadhaar", "aadhar", "uid", "uidai"],
    "PAN": ["pan", "permanent account", "income tax"],
    "IN_PHONE": ["mobile", "phone", "ph", "mob", "contact", "cell", "whatsapp"],
    "UPI": ["upi", "vpa", "payment", "gpay", "phonepe", "paytm"],
    "IFSC": ["ifsc", "rtgs", "neft", "imps", "bank code", "branch code"],
    "PASSPORT": ["passport", "pp no", "travel doc", "visa", "passport no"],
    "AADHAAR_VID": ["vid", "virtual id", "virtual aadhaar", "virtual id number"],
    "CVV": ["cvv", "cvc", "security code", "card verification", "cvv2", "cvc2"],
    "ACCOUNT_NUMBER": ["account", "a/c", "acct", "bank account", "savings", "current account", "acc no"],
    "BIOMETRIC": ["fingerprint", "biometric", "face template", "iris", "fp hash"],
    "DEVICE_ID": ["device", "device id", "android", "ios", "imei", "uuid", "device_id"],
}

#: Types and words for which a name recogniser's finding is a field label, not a value.
NAME_TYPES = ("PERSON", "LOCATION", "ORGANIZATION", "NRP")
LABEL_WORDS = ("email", "mail", "e-mail", "name", "address", "phone", "mobile", "contact", "cell", "pan", "aadhaar", "aadhar", "uid", "dob", "account", "ifsc", "upi", "vpa", "passport", "card", "date", "gender", "sex", "age", "id", "no", "number", "mob", "ph")

HIGH, MEDIUM = 0.85, 0.60
LABEL_BOOST, PROXIMITY_BOOST, DENSITY_BOOST = 0.15, 0.10, 0.10
LABEL_GAP, PROXIMITY_WINDOW, ANCHOR_ZONE = 50, 150, 300
ANCHOR_TYPES, ANCHOR_SCORE, CONTEXTUAL_TYPES, CONTEXTUAL_SCORE = ("PERSON", "EMAIL_ADDRESS"), 0.70, ("DATE_TIME", "LOCATION"), 0.85
UNCERTAIN, ANCHOR_BOOST, ANCHOR_LIFT = 0.55, 0.20, 0.70
DENSITY_HITS, COLUMN_SCORE = 3, 0.95
LAYER_PRIORITY = {"bert": 3, "spacy": 2, "regex": 1}
NAME_LAYER_SCORE, NAME_LAYER_CHARS = 0.85, 512

#: Python type to the viewer's type; anything else is a NAME.
VIEWER_TYPES: dict[str, str] = {
    "EMAIL_ADDRESS": "EMAIL", "IN_PHONE": "PHONE", "PHONE_NUMBER": "PHONE",
    "AADHAAR": "AADHAAR", "AADHAAR_VID": "AADHAAR", "PAN": "PAN", "PASSPORT": "PASSPORT",
    "PERSON": "NAME", "NAME": "NAME", "ORGANIZATION": "NAME", "NRP": "NAME",
    "LOCATION": "ADDRESS", "ADDRESS": "ADDRESS", "DATE_TIME": "DOB", "DATE_OF_BIRTH": "DOB",
    "CREDIT_CARD": "CARD_NUMBER", "CARD_NUMBER": "CARD_NUMBER", "ACCOUNT_NUMBER": "CARD_NUMBER", "CVV": "CVV", "UPI": "UPI", "IFSC": "UPI",
    "IP_ADDRESS": "IP_ADDRESS", "URL": "IP_ADDRESS", "DEVICE_ID": "IP_ADDRESS", "BIOMETRIC": "PASSPORT",
}
LAYER_NAMES = {"regex": "Regex Layer", "spacy": "spaCy NLP Layer", "bert": "BERT ML Layer"}
CHART_LAYERS = {"regex": "Regex", "presidio": "Presidio + spaCy", "indic_bert": "Indic BERT", "transformers": "Transformer Model", "spacy": "spaCy NER", "ml": "ML Model", "rule_based": "Rule-Based"}
MIME_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "sql": "text/plain", "csv": "text/csv", "txt": "text/plain", "md": "text/markdown", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
}

UPLOAD_TYPES = ("pdf", "docx", "doc", "sql", "csv", "txt", "json", "png", "jpg", "jpeg")
UPLOAD_BYTES, ENGINE_MB, CHUNK_MB = 52_428_800, 100, 5.0
STRUCTURED, UNSTRUCTURED, IMAGES = ("csv", "sql", "json"), ("txt", "pdf", "docx"), ("png", "jpg", "jpeg")
CHUNKS_STRUCTURED = {"csv": 10_000, "sql": 2_000, "json": 1_500}
CHUNKS_LARGE = {"txt": 100_000, "pdf": 15, "docx": 400}
CHUNKS_SMALL = {"txt": 30_000, "pdf": 5, "docx": 100}
TEXT_OVERLAP, STATEMENT_OVERLAP, SAMPLE_ROWS = 500, 2, 500
#: Marks round what a chunk has of its neighbours: of texts, and as patterns of scripts; and the lines that open a script.
OVERLAP_BEFORE, OVERLAP_AFTER = "###OVERLAP_BEFORE###", "###OVERLAP_AFTER###"
SCRIPT_BEFORE = r"(?s)--\s*CONTEXT_OVERLAP_START.*?--\s*CONTEXT_OVERLAP_END\s*\n?"
SCRIPT_AFTER = r"(?s)--\s*CONTEXT_OVERLAP_AFTER_START.*?--\s*CONTEXT_OVERLAP_AFTER_END\s*\n?"
SCRIPT_HEADER = r"(?i)\A(?:[^\S\n]*(?:--|#|(?:SET|USE)(?=\s))[^\n]*(?:\n|\z))*"
GRID, TILE_OVERLAP, SMALL_IMAGE = 4, 50, 400
COLLAPSE_OVER, COLLAPSE_CONTEXT = 5, 3
ANCHOR_CHARS, MOST_ORIGINAL, LEAST_BRIDGE, MOST_MASKED = 10, 400, 2, 200

# How texts are normalised, as (pattern, replacement), in order. \x0B is the vertical tab.
BEFORE_STRIP = [
    ("[\\u200b-\\u200d\\u2028\\u2029\\ufeff]", ""),
    ("[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]", " "),
    ("[\\u2011-\\u2015\\u2212]", "-"),
    (r"(?<=\d),(?=\d)", " "),
    (r"(?<=\d)_(?=\d)", "-"),
    (r"[ \t\r\f\x0B]+", " "),
    (r"\n{3,}", "\n\n"),
]
AFTER_STRIP = [
    (r"(?<=\d)l(?=\d)", "1"),
    (r"(?<=\d)l\b", "1"),
    (r"\bl(?=\d)", "1"),
    (r"(?<=\d)O(?=\d)", "0"),
    (r"(?<=\d)O\b", "0"),
    (r"\bO(?=\d)", "0"),
    (r"\b(\d{1,2})[.\-](\d{1,2})[.\-](\d{2,4})\b", "$1/$2/$3"),
]

# The shapes of masked values, in the order in which they are tried; all patterns of one must be found.
MASK_SHAPES: list[tuple[str, tuple[str, ...]]] = [
    ("PHONE", (r"^\+?[\d\s\-\*\(\)]{8,}$", r"\*")),
    ("IP_ADDRESS", (r"^\d+\.\*+\.\*+\.",)),
    ("IP_ADDRESS", (r"^\*+\.\*+\.\*+\.\*+$",)),
    ("CARD_NUMBER", (r"^[X\d*][\sX\d*\-]{11,19}$",)),
    ("PAN", (r"^[A-Z*]{5}[\dA-Z*]{5}$",)),
    ("AADHAAR", (r"^[\dX*\-\s]{12,16}$",)),
]
