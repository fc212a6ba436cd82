"""Wire formats, word lists and thresholds.

Everything in this module has to equal what existing catalogues already hold
(tokens inside metadata, folder names on disk, published thresholds), so it is
stated plainly as data.  No logic lives here.
"""

# --- fixed values: tokens stored in a record's Relation list ---------------
TOKEN_NAMESPACE = "jxlphoto-"
SRC = TOKEN_NAMESPACE + "src:"
SRCSUM = TOKEN_NAMESPACE + "srcsum:"
ORIGIN = TOKEN_NAMESPACE + "origin:"
ORIENTATION = TOKEN_NAMESPACE + "orientation:"
ICC_PROFILE = TOKEN_NAMESPACE + "iccprofile:"
DEPTH = TOKEN_NAMESPACE + "depth:"
GROUP = TOKEN_NAMESPACE + "mpg:"
PAGE = TOKEN_NAMESPACE + "page:"
PAGES = TOKEN_NAMESPACE + "pages:"
SUBFILETYPE = TOKEN_NAMESPACE + "subfiletype:"
EXTRASAMPLES = TOKEN_NAMESPACE + "extrasamples:"
SCAN = TOKEN_NAMESPACE + "scan:"
TIFFTAG = TOKEN_NAMESPACE + "tifftag:"
GRAYSCALE = TOKEN_NAMESPACE + "grayscale"
THUMB = TOKEN_NAMESPACE + "thumb"
ICC_INHERITED = TOKEN_NAMESPACE + "icc:inherited"
PIXSUM = TOKEN_NAMESPACE + "pixsum:"
DERIVED = TOKEN_NAMESPACE + "derived:"

# Tokens that describe one output and never travel as a user's own keyword.
INTERNAL_PREFIXES = (
    SRC, SRCSUM, GROUP, SUBFILETYPE, DEPTH, PAGE, PAGES, ICC_INHERITED,
    GRAYSCALE, THUMB, EXTRASAMPLES, TIFFTAG, SCAN, PIXSUM, DERIVED, ORIGIN,
    ICC_PROFILE,
)
# Tokens a derived copy loses: it must never prove that a source is archived.
DERIVED_DROPS = (SRC, SRCSUM, DERIVED)

# --- fixed values: the encode record (text form) ----------------------------
ENTRY_PATTERN = r"cjxl\s+d=([0-9.]+)\s+e=(\d+)"
BLOCK_PATTERN = (
    r"(?:^|\|)\s*(?:gen=\d+\s*\|\s*)?cjxl\s+d=[0-9.]+\s+e=\d+"
    r"(?:\s*\|\s*cjxl\s+d=[0-9.]+\s+e=\d+)*"
)
GEN_PATTERN = r"(?:^|\|)\s*gen=(\d+)\s*(?=\||$)"
LONE_RECORD_SEGMENT_PATTERN = r"(?:^|\|)\s*(?:gen=\d+|cjxl\s+d=[0-9.]+\s+e=\d+)\s*(?=\||$)"
NO_RECORD_SEGMENT = "no encode record"
ENCODE_SUFFIX_PATTERN = r"/d([0-9.]+)e(\d+)(s?)$"
QUALITY_SUFFIX_PATTERN = r"/q(\d+)$"

# --- fixed values: names on disk ---------------------------------------------
THUMBNAIL_SUFFIX = "_thumbnail"
PAGE_NAME_PATTERN = r"_page(\d+)$"
STAGED_NAME_PATTERN = r"^[0-9a-f]{32}_"
ORPHAN_TEMP_PATTERN = r"^(?:[0-9a-f]{32}_)+(?:repair_)?(.+?)(?:\.tmp)+$"
JOURNAL_NAME = "checksums.md5"
SELF_HASH_SUFFIX = ".jxl-md5"
EXPORT_MARKER = "_EXPORT"
COLLAPSING_MODES = (2, 4, 5, 6, 7)

# Folders other tools write into (lower case), and the folders of masters.
RESTORE_OUTPUT_FOLDERS = ("16b_tiff", "tiff_16bits", "converted_tiff")
DERIVE_OUTPUT_FOLDERS = ("recompressed_jxl", "jxl_recompressed", "jxl_small", "16b_jxl_small")
RECOVERED_OUTPUT_FOLDERS = ("recovered_jpeg", "jpeg_recovered", "converted")
TRANSCODE_OUTPUT_FOLDERS = ("jxl_jpeg", "converted_jxl")
MASTER_FOLDERS = ("16b_jxl", "converted_jxl", "jxl_16bits")
DERIVE_OUTPUT_SUFFIXES = ("_jxl_small",)

# --- fixed values: word lists --------------------------------------------------
SCANNER_SOFTWARE = (
    "SilverFast", "VueScan", "Epson Scan", "Nikon Scan", "FlexColor",
    "Frontier", "EZ Controller", "ScanGear", "Plustek",
)
THUMBNAIL_DROP_SOFTWARE = ("Capture One",)
HIDDEN_LOSS_ORIGINS = ("jpeg", "jxl", "jxl-lossy")
COUNTED_STATUSES = ("ok", "copied", "overwrite", "skipped", "aborted", "error")
MEMORY_ERROR_WORDS = (
    "winerror 1455", "memoryerror", "bad_alloc", "cannot allocate memory",
    "out of memory", "jxlencoderprocessoutput failed",
    "failed to create image frame", "getting pixel data failed",
)
GAIN_MAP_MARKS = (
    ("urn:iso:std:iso:ts:21496:-1", "ISO 21496-1"),
    ("http://ns.adobe.com/hdr-gain-map/1.0/", "Ultra HDR"),
    ("urn:com:apple:photo:2020:aux:hdrgainmap", "Apple"),
    ("http://ns.apple.com/HDRGainMap/1.0/", "Apple"),
)
MIME_BY_EXTENSION = {
    ".tif": "image/tiff", ".tiff": "image/tiff", ".jxl": "image/jxl",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
}
JPEG_EXTENSIONS = (".jpg", ".jpeg", ".jfif", ".jpe")
FIELD_FILL = (
    ("Keywords", "Subject"),
    ("Caption-Abstract", "Description"),
    ("By-line", "Creator"),
    ("ObjectName", "Title"),
    ("CopyrightNotice", "Rights"),
    ("Headline", "Headline"),
    ("City", "City"),
    ("Province-State", "State"),
    ("Country-PrimaryLocationName", "Country"),
    ("Country-PrimaryLocationCode", "CountryCode"),
    ("Sub-location", "Location"),
    ("Credit", "Credit"),
    ("Source", "Source"),
    ("SpecialInstructions", "Instructions"),
    ("DateCreated", "DateCreated"),
)

# --- fixed values: thresholds ----------------------------------------------------
DISTANCE_FLOOR = 0.05
STREAMED_EFFORT_CAP = 7
CAMERA_THUMB_MAX_SIDE = 160
DCF_THUMBNAIL_SIZES = ((160, 120), (120, 160))
ENCODABLE_PHOTOMETRICS = (1, 2)
EIGHT_BIT_LOSSLESS_UP_TO = 0.1
PRIVATE_TAG_MAX_BYTES = 4096
PRIVATE_TAG_TYPES = (1, 2, 6, 7)
LAYERS_TAG = 37724
IPTC_TAG = 33723
RESOURCES_TAG = 34377
PRIVATE_TAG_SKIP = (
    33432, 34665, 34853, 40965, 34675, 37724, 40091, 40092, 40093, 40094,
    40095, 50341, 50740, 59932, 59933,
)
PREFLIGHT_MIN_BYTES = 5 * 1024 ** 3
SAMPLE_COUNT = 3
SUMMARY_MAX_FAILURES = 200
STALE_WARN_LIMIT = 20
MEAN_RATIO_FLOOR = 0.7
PSNR_FLOOR_DB = 20.0
PEAK_16BIT = 65535.0
D50_ILLUMINANT_HEX = "0000F6D6000100000000D32D"
D50_UNITS = (63190, 65536, 54061)
D50_NEAR_UNITS = 4
PROFILE_SIZE_LIMIT = 51200
PROFILE_MIN_BYTES = 128
TILE_ROWS = 512

# --- fixed values: container layout (public ISO/IEC 18181-2 framing) --------------
CONTAINER_SIGNATURE_HEX = "0000000C4A584C200D0A870A"
BARE_SIGNATURE_HEX = "FF0A"
PNG_SIGNATURE_HEX = "89504E470D0A1A0A"
# A whole end chunk: no data, its type, its check sum.
PNG_END_HEX = "0000000049454E44AE426082"
TIFF_SIGNATURES_HEX = ("49492A00", "49492B00", "4D4D002A", "4D4D002B")
A2B_TAGS = ("A2B0", "A2B1", "A2B2")
B2A_TAGS = ("B2A0", "B2A1", "B2A2")
LUT_TAGS = (
    "A2B0", "A2B1", "A2B2", "B2A0", "B2A1", "B2A2",
    "D2B0", "D2B1", "D2B2", "D2B3", "B2D0", "B2D1", "B2D2", "B2D3",
)
