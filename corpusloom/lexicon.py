"""Word lists, patterns and factors that results depend on.

Everything in this file is a fixed value that has to equal the published
behaviour for results to agree; there is no logic here.
"""

# Stopwords of the answer metrics.
METRIC_STOPWORDS = [
    "yang", "dan", "di", "ke", "dari", "untuk", "dengan", "adalah",
    "ini", "itu", "atau", "ada", "jika", "dalam", "pada", "oleh",
    "the", "is", "are", "of", "in", "to", "and", "a", "an",
    "for", "by", "with", "it", "this", "that", "be", "as", "at",
    "was", "were",
]

# Stopwords of the chat keyword extraction.
CHAT_STOPWORDS = [
    "yang", "dan", "dari", "untuk", "ini", "itu", "pada", "adalah", "dengan", "tidak",
    "ada", "akan", "sudah", "juga", "atau", "bisa", "saya", "kita", "kami", "mereka",
    "dia", "pak", "bu", "mas", "mbak", "bang", "kak", "bos", "gan", "sis", "guys",
    "the", "is", "are", "was", "were", "be", "have", "has", "had", "do", "does", "did",
    "will", "would", "should", "could", "can", "may", "might", "must", "shall",
    "this", "that", "these", "those", "of", "to", "for", "in", "on", "at", "by", "with",
    "a", "an", "and", "or", "but", "if", "then", "than", "so", "very", "too", "also",
]

# Stopwords of the search term extraction.
TERM_STOPWORDS = [
    "apa", "siapa", "dimana", "kapan", "berapa", "bagaimana",
    "yang", "dan", "atau", "di", "ke", "dari", "dalam", "untuk",
]

# Affixes of the light stemmer, in the order they are tried.
STEM_SUFFIXES = ["kan", "an", "i", "nya", "lah", "kah"]
STEM_SUFFIXES_TABLE = ["kan", "an", "i", "nya", "lah", "kah", "pun"]
STEM_PREFIXES = ["me", "di", "ke", "se", "ber", "ter", "pe"]

# Synonyms for expanding document queries.
DOCUMENT_SYNONYMS = {
    "apa itu": ["definisi", "pengertian", "arti", "makna", "jelaskan"],
    "proses": ["tahapan", "langkah", "mekanisme", "cara kerja"],
    "auction": ["lelang", "penawaran", "bidding", "tender"],
    "buyback": ["pembelian kembali", "buyback cash", "buyback debt switch"],
    "lpdu": ["layanan perdagangan dealer utama", "dealer utama"],
    "lpksbn": ["lelang pembelian kembali surat berharga negara"],
    "settlement": ["penyelesaian transaksi", "setelmen"],
    "staple bonds": ["paket staple", "destination series", "source series"],
    "quotation": ["kuotasi", "penawaran", "quote"],
    "allocation": ["alokasi", "pemenang lelang"],
}

# Synonyms for expanding table queries.
TABLE_SYNONYMS = {
    "user": ["pengguna", "karyawan", "staff", "employee", "profil"],
    "product": ["produk", "barang", "item", "inventory"],
    "order": ["pesanan", "pembelian", "transaksi", "orderan", "pemesanan"],
    "price": ["harga", "cost", "biaya", "tarif", "nilai"],
    "quantity": ["jumlah", "kuantitas", "banyak", "stock"],
}

# Synonyms appended to a query.
APPEND_SYNONYMS = {
    "total": ["sum", "aggregate", "count", "all"],
    "average": ["mean", "avg", "rata-rata"],
    "highest": ["max", "maximum", "top", "largest"],
    "lowest": ["min", "minimum", "bottom", "smallest"],
    "how many": ["count", "number of", "total"],
    "list": ["show", "display", "get all"],
}

# Synonyms for expanding chat queries (the first two of each are used).
CHAT_SYNONYMS = {
    "nik": ["nomor induk karyawan", "employee id", "id karyawan"],
    "cuti": ["leave", "libur", "off", "saldo cuti"],
    "sisa": ["remaining", "tersisa", "balance"],
    "berapa": ["what is", "jumlah", "total"],
    "nama": ["name", "siapa"],
    "email": ["alamat email", "mail"],
    "telepon": ["phone", "hp", "nomor telepon"],
}

# Brand names that are never stemmed.
BRANDS = [
    "jetbrains", "jira", "confluence", "aws", "azure", "datadog",
    "sonarqube", "gitlab", "jenkins", "docker", "kubernetes", "sap",
]

# Word pairs that form a phrase.
PHRASES = [
    ("project", "manager"), ("tech", "lead"), ("qa", "lead"), ("backend", "developer"),
    ("frontend", "developer"), ("devops", "engineer"), ("finance", "manager"),
    ("hr", "manager"), ("it", "director"), ("business", "analyst"),
]

# Intent patterns.
INTENT_PATTERNS = {
    "data_retrieval": [
        r"berapa\s+(harga|jumlah|total|stock)",
        r"(harga|price)\s+[a-zA-Z0-9\s]+",
        r"siapa\s+yang",
        r"(cari|tampilkan|lihat)\s+(data|informasi)",
        r"^[a-zA-Z]+\s+\d+$",
    ],
    "comparison": [
        r"(bandingkan|perbandingan|vs\.?)",
        r"(lebih|paling)\s+(murah|mahal|banyak|sedikit)",
        r"mana\s+yang\s+(lebih|paling)",
    ],
    "aggregation": [
        r"(total|jumlah|rata-rata|rerata|average|sum)\s+[a-zA-Z]",
        r"berapa\s+total",
        r"hitung\s+(total|jumlah)",
        r"(semua|semua\s+data)\s+[a-zA-Z]",
    ],
    "explanation": [
        r"apa\s+itu",
        r"jelaskan\s+tentang",
        r"definisi\s+dari",
        r"bagaimana\s+cara",
        r"proses\s+[a-zA-Z]",
    ],
}
INTENT_PRIORITY = ["aggregation", "comparison", "data_retrieval", "explanation"]

# Keyword lists of the second intent form.
KEYWORD_AGGREGATION = [
    "total", "sum", "jumlah", "keseluruhan", "berapa banyak", "how many", "count", "hitung",
    "rata-rata", "average", "avg", "tertinggi", "highest", "max", "maximum",
    "terendah", "lowest", "min", "minimum",
]
KEYWORD_EXPLANATION = [
    "explain", "what is", "how does", "describe", "definition", "definisi",
    "deskripsikan", "bagaimana", "apa itu", "jelaskan",
]
KEYWORD_CHAT = [
    "conversation", "chat", "message", "said", "discussed", "diskusi", "pesan",
    "berkata", "dikatakan", "percakapan",
]

# Source weights (table, document, chat) by intent.
INTENT_WEIGHTS = {
    "aggregation": (1.0, 0.3, 0.2),
    "explanation": (0.4, 1.0, 0.5),
    "data_retrieval": (0.7, 0.6, 0.5),
    "other": (0.6, 0.6, 0.5),
}
KEYWORD_WEIGHTS = {
    "aggregation": (1.0, 0.3, 0.2),
    "explanation": (0.4, 1.0, 0.5),
    "chat": (0.3, 0.4, 1.0),
    "other": (0.7, 0.8, 0.6),
}

# Routing keywords.
ROUTE_TABLE_WORDS = [
    "user", "profile", "customer", "product", "order", "price",
    "jumlah", "total", "data", "tabel", "table", "database", "sql",
    "nama", "email", "alamat", "tanggal", "date", "harga", "stock",
    "karyawan", "transaksi", "pesanan", "siapa", "pegawai", "staff",
    "anggota", "member", "pelanggan", "department", "departemen",
]
ROUTE_DOCUMENT_WORDS = [
    "lpdu", "lpksbn", "buyback", "debt switch", "auction", "lelang",
    "sun", "sbn", "djppr", "mofids", "dealer utama", "settlement",
    "quotation", "kuotasi", "alokasi", "staple bonds", "securities",
    "fungsional", "persyaratan", "kode a", "lpdu-bcds", "lpdu-sa", "lpdu-dssb",
    "maker checker", "enrich data", "plte", "bank indonesia",
    "sop", "prosedur", "standar", "approval", "deployment", "testing",
    "development", "sdlc", "requirement", "design", "maintenance",
]
ROUTE_TABLES = {
    "user_profiles": [
        "user", "pengguna", "karyawan", "staff", "employee", "profil",
        "nama", "email", "department", "position", "jabatan", "pegawai",
        "siapa", "orang", "anggota", "member", "kontak", "telepon", "phone",
        "divisi", "departemen", "bagian",
    ],
    "products": [
        "product", "produk", "barang", "item", "harga", "price",
        "stock", "stok", "kategori", "category", "jual", "beli",
        "license", "software", "tools", "service",
    ],
    "orders": [
        "order", "pesanan", "pembelian", "transaksi", "beli", "pesan",
        "status", "pending", "completed", "shipped", "quantity",
        "total", "amount", "tanggal", "invoice", "processing", "proyek",
    ],
}
PERSON_WORDS = [
    "siapa", "who is", "nama", "karyawan bernama", "user bernama",
    "cari orang", "find person", "profile", "kontak", "contact",
    "email", "telepon", "phone",
]
PERSON_TABLE = "user_profiles"
PERSON_QUESTION_WORDS = ["siapa", "who", "handle", "contact"]
PERSON_SNIPPET_WORDS = ["siapa", "who", "handle"]

# Entity patterns of a question (matched ignoring case; \b marks a word edge).
ENTITY_PATTERNS = {
    "product_names": r"\b(Laptop|Smartphone|Chair|Software|Mouse|ThinkPad|Galaxy|Ergonomic|Project|JetBrains|SAP|Jira|Confluence|AWS|Azure|Datadog|SonarQube|GitLab|Jenkins|Docker|Kubernetes)\b",
    "departments": r"\b(IT|HR|Finance|Marketing|Sales|Operations)\b",
    "positions": r"\b(Engineer|Manager|Analyst|Specialist|Administrator|Director)\b",
    "currencies": r"Rp\s*\d+[.,]\d+|\d+\s*(juta|ribu)",
    "numbers": r"\b\d+\b",
    "dates": r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}",
}
FIELD_WORDS = {
    "harga": "price", "nama": "name", "email": "email",
    "departemen": "department", "posisi": "position",
    "jumlah": "quantity", "stok": "stock_quantity", "status": "status",
}

# Patterns that name a file in a question, in order.
FILE_PATTERNS = [
    r"dari file\s+([\w_-]+)",
    r"file\s+([\w_-]+)",
    r"di\s+([\w_-]+\.txt)",
    r"tentang\s+([\w_-]+)",
    r"([\w_-]+\.txt)",
]

# Words that name an aggregate, in order of precedence, and usual measure columns.
AGGREGATE_WORDS = {
    "SUM": ["total", "sum", "jumlah", "keseluruhan"],
    "COUNT": ["berapa banyak", "how many", "count", "hitung"],
    "AVG": ["average", "rata-rata", "rata2", "avg"],
    "MIN": ["minimum", "min", "terkecil", "terendah"],
    "MAX": ["tertinggi", "highest", "max", "maximum"],
}
MEASURE_WORDS = ["price", "harga", "amount", "total", "quantity", "qty"]

# Chat line patterns, in order; groups are date, time, sender, text.
CHAT_LINE_PATTERNS = [
    r"^\[(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\]\s*([^:]+):\s*(.*)",
    r"^\[(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2}(?::\d{2})?)\]\s*([^:]+):\s*(.*)",
    r"^(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2}(?::\d{2})?)\s*-\s*([^:]+):\s*(.*)",
    r"^(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2}\s*(?:AM|PM)?)\s*-\s*([^:]+):\s*(.*)",
]
CHAT_SYSTEM_PATTERNS = [
    "Messages and calls are end-to-end encrypted",
    "created group", "added you", "removed you", "left the group",
    "changed the subject", "changed this group", "security code changed",
    "<Media omitted>", "missed voice call", "missed video call",
]
# Date and time formats, tried in this order.
CHAT_DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "d/M/yy", "M/d/yyyy", "M/d/yy", "yyyy/M/d"]
CHAT_TIME_FORMATS = ["H:m:s", "H:m", "h:m:s a", "h:m a", "h:ma"]
# The digit shape each format can read at all.
CHAT_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d+-\d+$", "d/M/yyyy": r"/\d{4}$", "d/M/yy": r"/\d{2}$", "M/d/yyyy": r"/\d{4}$", "M/d/yy": r"/\d{2}$",
    "yyyy/M/d": r"^\d{4}/", "H:m:s": r"^\d+:\d+:\d+$", "H:m": r"^\d+:\d+$", "h:m:s a": r":\d+:\d+ [AP]M$",
    "h:m a": r"^\d+:\d+ [AP]M$", "h:ma": r"^\d+:\d+[AP]M$",
}

# Lines of a pasted Teams chat that carry no message.
PASTED_NOISE = (
    r"(?i)^(2 new notifications|New missed calls|Activity in other accounts.*|"
    r"Has context menu|Chat$|Unread$|Channels$|Chats$|Meeting chats$|"
    r"Press Ctrl\+F to find.*|Unread messageLast message.*|See more.*|"
    r"Community.*|Temporarily shown.*|Badged chat.*|Meet now|"
    r"Call (started|ended) at.*|\d+ new notification.*|, \+\d+$|"
    r"\d+$)"
)
PASTED_QUOTE = r"(?i)^Begin quote,"
PASTED_PREVIEW = r"^.+\sby\s.+$"
PASTED_TIME = r"(?i)^(\d{1,2}/\d{1,2}/\d{4})\s+(\d{1,2}:\d{2})\s*([AP]M)$"
PASTED_NAME = r"^[A-Z][a-zA-Z]+(\s[A-Z][a-zA-Z]+)*$"

# Drawing characters removed from text.
ARROW_CHARS = "→←↑↓►◄▲▼■□●○◆◇"
BAR_CHARS = "|│┃┆┊╎"
RULE_CHARS = "-─━"

# Phrases and markers of the degenerate-text filter.
DEGENERATE_PHRASES = [
    "pertanyaan pertanyaan", "berdasar konteks", "jawab pertanyaan", "answer the question",
    "based on context", "tidak ada informasi", "no information", "context:", "question:",
    "yang bersama yang bersama", "bersama yang bersama", "yang berkata terjadi",
    "berkata tidak berkata", "data pertanyaan tahun", "data pertanyaan tersebut",
    "format yang bersah",
]
FIELD_MARKERS = ["id:", "name:", "email:", "@", "department:", "position:", "phone:"]
CONSONANT_RUN = "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{4,}"

# Phrases of an answer that is a refusal or echoes the prompt.
REFUSAL_PHRASES = [
    "maaf,", "tidak tahu", "tidak menemukan", "no information",
    "based on the context", "context:", "question:", "answer:",
    "- hanya berdasar", "jangan gunakan", "instruksi penting",
    "jawab hanya berdasarkan", "informasi tidak ditemukan dalam dokumen yang diunggah",
]

# Direct extraction.
PHONE_PATTERN = r"(\+?62[-\s]?\d{3}[-\s]?\d{4}[-\s]?\d{4}|\d{4}|ext\.\s*\d+)"
EMAIL_PATTERN = r"[\w\.-]+@[\w\.-]+"
PHONE_WORDS = ["nomor", "telepon", "hp", "kontak"]

# Confidence factor by result type and intent boosts.
CONFIDENCE = {"pdf": 0.8, "database": 0.9, "chat": 0.7, "public_link": 0.85, "external_db": 0.9}
TABLE_TYPES = ["database", "external_db"]
INTENT_BOOST = 1.5

# Conflict patterns.
NUMBER_PATTERN = r"(?i)(?:Rp\s*|\$)?([0-9.,]*[0-9][0-9.,]*)\s*(?:ribu|juta|rb|jt|k|million)?"
ROLE_PATTERN = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"

# Separator ladders of the text splitter.
SEPARATORS_DOCUMENT = ["\n\n", "\n", ". ", " ", ""]
SEPARATORS_PAGE = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]
SEPARATORS_FRESH = ["\n\n", "\n", ".", "!", "?", ",", " ", ""]
SEPARATORS_PLAIN = ["\n\n", "\n", " ", ""]
