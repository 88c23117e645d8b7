"""Fixed values of the inventory's semantics.

Everything here must equal the published behaviour for results to match; none of it is tuning.
"""

# Page-level bounds (fixed values).
MAX_UNITS = 1000
MAX_STYLESHEETS = 3
MAX_RAW_CANDIDATES = 5000
MAX_STYLE_TEXT = 262_144
MAX_DATA_URI = 102_400
MAX_NOSCRIPT_TEXT = 1_048_576
MAX_HTML_BYTES = 5_242_880
MAX_ROBOTS_BYTES = 102_400
MAX_SHEET_BYTES = 1_048_576

# Image transfer bounds (fixed values).
MAX_ANNOUNCED_IMAGE_BYTES = 50 * 1024 * 1024
MAX_STREAMED_IMAGE_BYTES = 20 * 1024 * 1024
PREFIX_BYTES = 4096
MAX_REDIRECTS = 3
MAX_REQUESTS_PER_SCAN = 100

# View bounds (fixed values).
REVEAL_BATCH = 120
AUTO_PROBE_LIMIT = 24
MEASURE_WARN_AT = 200
BUNDLE_MEMBERS = 500
BUNDLE_BYTES = 64_000_000
UNKNOWN_WEIGHT = 16_000_000
RATE_WINDOW_MS = 3_600_000
RATE_LIMITS = {"scan": 30, "proxy": 1000}

# Formats in display order, with their labels (fixed values).
FORMATS = ["png", "jpeg", "svg", "gif", "webp", "avif", "ico", "unknown"]
FORMAT_LABELS = {"jpeg": "JPG"}
FORMAT_ALIASES = {"jpg": "jpeg"}

EXT_BY_SUFFIX = {
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "jfif": "jpeg", "svg": "svg",
    "gif": "gif", "webp": "webp", "avif": "avif", "ico": "ico",
}
EXT_BY_MIME = {
    "png": "png", "jpeg": "jpeg", "jpg": "jpeg", "svg+xml": "svg", "gif": "gif",
    "webp": "webp", "avif": "avif", "x-icon": "ico", "vnd.microsoft.icon": "ico",
}
SUFFIX_BY_CONTENT_TYPE = {
    "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp",
    "image/avif": "avif", "image/svg+xml": "svg", "image/x-icon": "ico",
    "image/vnd.microsoft.icon": "ico",
}

# The fourteen kinds of image reference and the five user-facing groups (fixed values).
SOURCE_GROUPS = {
    "page": ["img", "srcset", "picture", "lazy"],
    "css": ["style-attr", "style-block", "stylesheet"],
    "svg": ["inline-svg"],
    "meta": ["meta", "favicon", "json-ld"],
    "media": ["poster", "object", "embed"],
}
GROUP_OF_SOURCE = {s: g for g, members in SOURCE_GROUPS.items() for s in members}
ICON_SOURCES = ["favicon", "inline-svg"]

# Attribute and key names that are collected, in collection order (fixed values).
LAZY_ATTRS = ["data-src", "data-lazy-src", "data-original", "data-srcset", "data-bg"]
META_IMAGE_KEYS = [
    "og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src",
]
ICON_RELS = ["icon", "apple-touch-icon", "apple-touch-icon-precomposed"]

# SVG attribute names whose capitals are lost by HTML tokenization; from the HTML standard's
# "adjust SVG attributes" table (fixed values).
SVG_ATTRIBUTE_NAMES = [
    "attributeName", "attributeType", "baseFrequency", "baseProfile", "calcMode", "clipPathUnits",
    "diffuseConstant", "edgeMode", "filterUnits", "glyphRef", "gradientTransform", "gradientUnits", "kernelMatrix",
    "kernelUnitLength", "keyPoints", "keySplines", "keyTimes", "lengthAdjust", "limitingConeAngle", "markerHeight",
    "markerUnits", "markerWidth", "maskContentUnits", "maskUnits", "numOctaves", "pathLength",
    "patternContentUnits", "patternTransform", "patternUnits", "pointsAtX", "pointsAtY", "pointsAtZ",
    "preserveAlpha", "preserveAspectRatio", "primitiveUnits", "refX", "refY", "repeatCount", "repeatDur",
    "requiredExtensions", "requiredFeatures", "specularConstant", "specularExponent", "spreadMethod", "startOffset",
    "stdDeviation", "surfaceScale", "systemLanguage", "tableValues", "targetX", "targetY", "textLength", "viewBox",
    "viewTarget", "xChannelSelector", "yChannelSelector", "zoomAndPan",
]
SVG_NAMESPACE = "http://www.w3.org/2000/svg"
# Start tags that end foreign content (fixed values, HTML standard).
FOREIGN_BREAKOUT_TAGS = [
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span",
    "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var",
]
HTML_VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
]

# Reserved IPv4 ranges: (cidr, first address, prefix bits) (fixed values, IANA registries).
RESERVED_V4 = [
    ("127.0.0.0/8", 0x7F000000, 8),
    ("10.0.0.0/8", 0x0A000000, 8),
    ("172.16.0.0/12", 0xAC100000, 12),
    ("192.168.0.0/16", 0xC0A80000, 16),
    ("169.254.0.0/16", 0xA9FE0000, 16),
    ("100.64.0.0/10", 0x64400000, 10),
    ("0.0.0.0/8", 0x00000000, 8),
    ("192.0.2.0/24", 0xC0000200, 24),
    ("198.51.100.0/24", 0xC6336400, 24),
    ("203.0.113.0/24", 0xCB007100, 24),
    ("198.18.0.0/15", 0xC6120000, 15),
    ("224.0.0.0/4", 0xE0000000, 4),
    ("240.0.0.0/4", 0xF0000000, 4),
]
INTERNAL_HOSTNAMES = ["localhost", "metadata.google.internal", "metadata.goog", "instance-data"]
INTERNAL_SUFFIXES = [".local", ".internal", ".localdomain", ".localhost"]

# Outcome code -> (HTTP status, message, retryable) (fixed values).
_UNREACHABLE = "That address isn't reachable from the public internet."
ERROR_CATALOG = {
    "invalid-url": (400, "That doesn't look like a valid web address.", False),
    "bad-scheme": (400, "Only http and https pages can be scanned.", False),
    "bad-port": (400, "Pages on non-standard ports can't be scanned.", False),
    "private-ip": (403, _UNREACHABLE, False),
    "blocked-hostname": (403, _UNREACHABLE, False),
    "dns-private": (403, _UNREACHABLE, False),
    "domain-blocked": (
        403, "This site is excluded from this tool — at its owner's request, or for abuse prevention.", False),
    "dns-nxdomain": (404, "We couldn't find that domain — check the URL and try again.", False),
    "dns-error": (502, "We couldn't verify that domain right now. Please try again shortly.", True),
    "too-many-redirects": (502, "The page redirected too many times.", False),
    "timeout": (504, "The page took too long to respond.", True),
    "not-an-image": (415, "That URL doesn't point to an image.", False),
    "size-limit": (413, "This image is larger than the size limit.", False),
    "upstream-error": (502, "The image's server responded with an error.", False),
    "upstream-network": (
        502, "That server couldn't be reached — it may be down or refusing connections.", True),
    "invalid-request": (400, "That doesn't look like a valid web address.", False),
    "rate-limited": (429, None, False),
}

# Messages of the rate limits by kind; {m} is the time to wait in minutes (fixed values).
RATE_MESSAGES = {
    "scan": "This tool allows 30 page scans per hour for each network connection, and the allowance is shared — on mobile "
            "networks and shared Wi-Fi, many people can count against the same connection. The limit resets within the "
            "hour; try again in about {m}.",
    "proxy": "The hourly image limit (1,000 image requests per network connection) was reached. The allowance is shared by "
             "everyone on your network connection, and resets within the hour — try again in about {m}.",
}

# Footnotes of the bundle's skip report, in report order (fixed values).
SKIP_FOOTNOTES = [
    ("rate-limit",
     "rate-limit: the hourly image allowance was reached — {these} retryable after the limit "
     "resets (within the hour)."),
    ("http-415",
     "http-415: these URLs served something that isn't an image (fonts, stylesheets) — the proxy "
     "passes image types only. Nothing was lost."),
    ("http-403",
     "http-403: the site's server refused these requests — some sites block downloads that don't "
     "come from their own pages."),
    ("truncated",
     "truncated: these transfers ended early or exceeded the size limit — partial files are never "
     "written into the archive, so these members were dropped whole."),
]

# Landing-page presets: name -> (formats, groups) (fixed values).
SAVED_FILTERS = {
    "png-images": (["png"], []),
    "svg-images": (["svg"], []),
    "favicon": ([], ["meta"]),
    "og-image": ([], ["meta"]),
    "shop-products": ([], ["page"]),
}
