"""Fixed values.

Everything in this file decides results by its exact spelling: names of states and
methods, status codes, URL formats, markers and the phrases that give away an error
page.  They are data, kept as plain text in one place.
"""

# ---- fixed values: names -------------------------------------------------------------

# Ledger entries are written per stage of an import.
CAPTURE_STAGE = "web_archive_new"
WORK_STAGE = "raw_new"

NO_METHOD = "no_method"
NOT_POSSIBLE = "not_possible"
PENDING_METHOD = "pending"
LOGIN_METHOD = "login"
GATED_METHODS = ["12ft_ladder", "remove_paywall"]

PENDING = "PENDING"
RETRIEVED = "RETRIEVED"
FAILED = "FAILED"
PARSED = "PARSED"
RESCRAPE = "RESCRAPE"
INDEX_ERROR = "INDEX_ERROR"

RAW = "RAW"
READER = "READER"
BOTH = "BOTH"
PDF = "PDF"
NONE = "NONE"

UNKNOWN_LANGUAGE = "unknown"

# ---- fixed values: archive captures --------------------------------------------------

CAPTURE_FIELDS = [
    "urlkey",
    "timestamp",
    "original",
    "mimetype",
    "statuscode",
    "digest",
    "length",
]
UNUSABLE_STATUS = [
    "401", "508", "403", "502", "402", "405", "429", "520", "500", "409", "404", "-",
]
REDIRECT_STATUS = ["308", "301", "307", "302", "303"]

CAPTURE_URL_PREFIX = "https://web.archive.org/web/"
INDEX_URL_PREFIX = "http://web.archive.org/cdx/search/cdx?url="
READER_URL_PREFIX = "about:reader?url="
PDF_MARK = ".pdf"

INDEX_TRIES = 5
CHUNK_SIZE = 15
PARSE_BATCH = 500

# ---- fixed values: wording found in pages --------------------------------------------

NOT_ARCHIVED = "The Wayback Machine has not archived that URL."
EXCLUDED = "This URL has been excluded from the Wayback Machine."
NO_PERMISSION = "You don't have permission to access"
NO_PERMISSION_DOUBLED = "You don''t have permission to access"
READER_LOADING_ERROR = "Fallo al cargar el "
READER_ARCHIVE_LOGO = '<title id="reader-title">Internet Archive logo</title>'
ARCHIVE_HOST_MARK = "web.archive"
LOREM_MARK = "Sed ut perspiciatis"
REDIRECTING_MARK = "Redirecting to..."

READER_TITLE_CLASS = "reader-title"
READER_BODY_CLASS = "moz-reader-content reader-show-element"
READER_CREDITS_CLASS = "credits reader-credits"
READER_CONTENT_CLASS = "content"

ARCHIVE_BANNER = r"<p>The Wayback Machine - https://web\.archive\.org/web/[^\n]*?</p>"
SHORT_ENTITY = r"&[^;]{0,5};"
ESCAPED_APOSTROPHES = ["&#39;", "#39;"]
APOSTROPHES = "\"ʺ“”ˊ˴‘´`ˈʿˋʼʻˮ’ʽʹʾ'"

# Blanks that are stripped from both ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---- fixed values: phrases of error pages --------------------------------------------

TITLE_PHRASES = [
    "log in",
    "wayback machine",
    "gateway time-out",
    "attention required!",
    "access denied",
    "page does not exist",
    "error page",
    "cannot be found",
    "page not found",
    "file not found",
    "service unavailable",
    "server error",
    "content not available",
    "page is missing",
    "webpage does not exist",
    "unable to find the requested page",
    "the page you're looking for is not here",
    "this URL does not lead to an existing page",
    "the requested resource is missing",
    "the page you entered could not be located",
    "webpage unavailable",
    "unable to locate page",
    "page missing",
    "resource not found",
    "the requested page could not be found",
    "this page isn't available",
    "the URL you entered could not be found on the server",
    "page is inaccessible",
    "the requested URL is not found",
    "this webpage is not available",
    "the URL you're trying to access does not exist",
    "the resource you're trying to access is not available",
    "apologies the requested page is not available",
    "regrettably the webpage you're trying to access does not exist",
    "unfortunately the URL you entered could not be located",
    "sorry the resource you're looking for is missing",
    "regretfully the page you're trying to reach is inaccessible",
]
# A title that is nothing but this word, and numbers that count as error codes.
TITLE_WHOLE = "error"
TITLE_NUMBERS = ["4[0-9]{2}", "5[0-9]{2}", "4[0-9]{2}[^\\n]0", "5[0-9]{2}[^\\n]0"]
# In compatible mode these titles must be followed by a blank.
TITLE_PHRASES_BEFORE_BLANK = [
    "log in",
    "wayback machine",
    "gateway time-out",
    "attention required!",
    "access denied",
]

BODY_PHRASES = [
    "too many requests",
    "is parked free courtesy of godaddy com",
    "cannot be found",
    "page not found",
    "can't find the page",
    "cannot find the page",
    "service unavailable",
    "server error",
    "page is missing",
    "webpage does not exist",
    "unable to find the requested page",
    "the page you're looking for is not here",
    "this URL does not lead to an existing page",
    "the page you entered could not be located",
    "webpage unavailable",
    "unable to locate page",
    "page does not exist",
    "page missing",
    "the requested page could not be found",
    "this page isn't available",
    "the URL you entered could not be found on the server",
    "page is inaccessible",
    "the requested URL is not found",
    "this webpage is not available",
    "the URL you're trying to access does not exist",
    "apologies the requested page is not available",
    "regrettably the webpage you're trying to access does not exist",
    "unfortunately the URL you entered could not be located",
    "regretfully the page you're trying to reach is inaccessible",
]
# This one may start in the middle of a word.
BODY_SIGN_UP = "don't have an account? sign up"
# In compatible mode: followed by a blank; the parked-domain phrase keeps its
# punctuation (which the clean-up has removed, so it never matches).
BODY_PHRASES_BEFORE_BLANK = [
    "too many requests",
    "is parked free, courtesy of godaddy.com",
]
BODY_PARKED = "is parked free courtesy of godaddy com"

# ---- fixed values: languages ---------------------------------------------------------

# Frequent short words per language (two-letter codes).
STOP_WORDS = {
    "cs": "je se že jsou jako jsem také podle byl byla které který při nebo až však protože jeho už pouze",
    "da": "og ikke jeg er det på til af med som fra efter blev også eller når være havde mig hvad",
    "de": "der die das und ist in zu den von mit nicht ein eine für auf sich auch im dem des",
    "en": "the a of and to in is that it was for on with as are this be at by from or",
    "es": "el la los las de que y en un una es por con para no se del al lo su",
    "fr": "le la les des et de du un une que qui dans pour est en au par sur pas avec",
    "it": "il lo la gli di che e in un una per non con del della dei sono alla anche più",
    "nl": "de het een en van in is dat op te zijn voor met niet aan er om ook als door",
    "pl": "się nie jest przez jak dla oraz był była które który także tylko jego tego może być czy po są",
    "pt": "o a os as de que e do da em um uma para com não por dos das no na",
    "sv": "och att det som på är för av inte till han jag ett så hade sig från också eller när efter över",
}
# Scripts that give a language away where they hold most letters; the earlier of equal ones counts.
SCRIPT_LANGUAGES = [
    ("Hangul", "ko"),
    ("Hiragana", "ja"),
    ("Katakana", "ja"),
    ("Han", "zh"),
    ("Cyrillic", "ru"),
    ("Greek", "el"),
    ("Arabic", "ar"),
    ("Hebrew", "he"),
    ("Thai", "th"),
    ("Devanagari", "hi"),
]
