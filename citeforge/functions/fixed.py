"""Expressions, word lists and limits that results depend on."""

from __future__ import annotations

# Expressions, in Java's dialect. (?i) folds ASCII letters, (?iu) all letters.
DOI = r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)"
DOI_PREFIXED = r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi\s*[:.]?\s*)(10\.\d{4,9}/[^\s\"<>]+)"
DOI_LOOSE = r"(?i)(10\.\d{4,9}\s*/\s*[^\s\"'<>]+)"
DOI_HIDDEN = r"(?i)(?:https?://(?:dx\.)?doi\.org/\s*|doi\s*[:.]?\s*)?(10\.\d{4,9}\s*/\s*[^\s\"'<>]+)"
DOI_LINK = r"(?i)https?://doi\.org/(10\.\S+)"
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi\s*[:.]?\s*)"
DOI_PREFIX_PLAIN = r"(?i)^(?:https?://doi\.org/|doi\s*[:.]?\s*)"
DOI_ENDPOINT = r"(?i)/(?:bibtex|endnote|ris|reference-manager|full|abstract|pdf)$"
DOI_CONTINUATION = r"\s+([0-9][0-9._;()/-]{0,20})"
DOI_OR_URL = r"(?i)(?:https?://(?:dx\.)?doi\.org/\S+|doi\s*[:.]?\s*10\.\d{4,9}/\S+|10\.\d{4,9}/\S+)"
URL = r"(?i)https?://\S+|www\.\S+"
SOURCE_TAG = r"(?i)\[(?:crossref|pubmed|google scholar)\s*\]"
SOURCE_TAG_WIDE = r"(?i)\[(?:CrossRef|PubMed|Link|Google Scholar)\]"
LEADING_NUMBER = r"^\s*(?:\[[0-9]+\]|[0-9]+[.)])\s*"
NOISE = r"(?iu)\[(?:CrossRef|PubMed|Google Scholar|Video)\]|\b(?:retrieved|accessed|erişim|erisim)\s+(?:from|tarihi)?\b.*$"
ACCESS_TAIL = r"(?iu)\b(?:retrieved|accessed|erişim|erisim)\b.*$"
YEAR = r"\b(19[0-9]{2}|20[0-3][0-9])\b"
YEAR_WIDE = r"\b(18\d{2}|19\d{2}|20[0-3]\d)\b"
WORD_TR = r"[A-Za-zÇĞİÖŞÜçğıöşü0-9]+"
JOINING_APOSTROPHE = r"(?<=[A-Za-zÇĞİÖŞÜçğıöşü])[’'`´](?=[A-Za-zÇĞİÖŞÜçğıöşü])"
BROKEN_WORD = r"([A-Za-zÇĞİÖŞÜçğıöşü])-\s+([A-Za-zÇĞİÖŞÜçğıöşü])"
HYPHENATED = r"([a-zçğıöşü]{3,})-([a-zçğıöşü]{2,})"
ARTICLE_LIKE = (
    r"(?i)\b\d+\s*\(\s*\d+\s*\)\s*[:,]\s*\d+\s*[-–]\s*\d+"
    r"|\b\d+\s*[:,]\s*\d+\s*[-–]\s*\d+"
    r"|\[(?:CrossRef|PubMed)\]"
)
ISBN = r"(?i)(?:ISBN(?:-1[03])?[:\s]*)?((?:97[89][-\s]?)?[0-9][0-9Xx][-\s0-9Xx]{8,20})"
BIOMEDICAL = (
    r"(?iu)\b("
    r"JAMA|Lancet|BMJ|PubMed|Medline|Medicine|Medical|Clinical|Clinic|Nurs|Nursing|"
    r"Pediatr|Pediatric|Cardiovasc|Surg|Surgery|Oncol|Cancer|Neurol|Psychiat|"
    r"Ophthalmol|Radiol|Pharm|Biol|Chem|Health|Hosp|Ther|Disease|Patient|"
    r"Hemşire|Hemsire|Sağlık|Saglik|Tıp|Tip|Pediatri|Klinik"
    r")\b"
)
VOLUME_PAGE = (
    r"\b(\d{1,4})\s*\([^)]{0,25}\)\s*[:,]\s*(\d{1,6})",
    r"\b(\d{1,4})\s*[:,]\s*(\d{1,6})",
    r"\b(\d{1,4})\s*;\s*\d{0,4}\s*:?\s*(\d{1,6})",
)
REPOSITORY = r"(?i)dergipark\.(?:org|gov)\.tr/(?:tr|en)?/?"
SET_PAIR = r"(?s)setName\s+(.+?)\s+setSpec\s+([A-Za-z0-9_.-]+)\s+"

# The citation patterns, tried in this order.
_Y = r"(18\d{2}|19\d{2}|20[0-3]\d)"
QUOTED = rf"(?iu)[\"“‘']([^\"”’']{{12,250}})[\"”’']\s*,?\s*([^,.;()]{{4,160}}).*?{_Y}.*?(\d+\s*[-–]\s*\d+)"
APA = rf"(?iu)^(.+?)\s*\({_Y}[a-z]?\)\.?\s+(.+?)\.\s+([^.;]+?)\s*[,;]\s*\d{{1,4}}\s*(?:\([^)]{{0,25}}\))?\s*[:,]?\s*\d+\s*[-–]\s*\d+"
VANCOUVER = rf"(?iu)([^.;]+?)\s*[.;,]?\s*{_Y}\s*;\s*\d{{1,4}}\s*(?:\([^)]{{0,25}}\))?\s*:\s*\d+\s*[-–]\s*\d+"
LOOSE = rf"(?iu)^(.+?)\s+{_Y}\.?\s+(.+?)\.\s+([^.;]+?)\s*[;,]\s*\d{{1,4}}\s*(?:\([^)]{{0,25}}\))?\s*:\s*\d+\s*[-–]\s*\d+"
VOLUME_PAGES = rf"(?iu)([^.;]+?)\s*[,;]\s*{_Y}?\s*[,;]?\s*(\d{{1,4}})\s*(?:\(([^)]{{1,25}})\))?\s*[:,]\s*(\d+\s*[-–]\s*\d+)"

# Category expressions, in the order of precedence; ``other`` is what fits none.
CATEGORIES = {
    "hidden_doi": r"(?iu)\b10\.\d{4,9}\s*/\s*\S+",
    "dergipark_file": r"(?iu)dergipark\.org\.tr.*download/article-file",
    "thesis": r"(?iu)\b(thesis|dissertation|tez[ıi]?|yüksek lisans|yuksek lisans|doktora|master.?s thesis|unpublished master)\b",
    "report_policy_legal": (
        r"(?iu)\b(report|rapor|OECD|World Bank|WHO|UNICEF|UNFCCC|TÜİK|TUİK|TUIK|Bakanlığı|Ministry|"
        r"Guideline|kılavuz|Kanun|Hukuk|Yarg[ıi]tay|Resmi Gazete|mevzuat)\b"
    ),
    "url_web": r"(?iu)https?://|www\.|retrieved|accessed|erişim|erisim|YouTube|Twitter|Facebook|Instagram|gazete|haber",
    "conference": r"(?iu)\b(conference|proceedings|symposium|kongre|sempozyum|bildiri|congress)\b",
    "book_or_chapter": (
        r"(?iu)\b(Yayınları|Yay[ıi]n|Yay[ıi]nc[ıi]l[ıi]k|Yay[ıi]nevi|Kitap|Kitab[ıi]|Kitapları|"
        r"Kitabevi|Matbaa|Matbaas[ıi]|Bas[ıi]mevi|Bas[ıi]|Bası|Neşriyat|Nesriyat|Verlag|Books|"
        r"Press|Publisher|Publishing|Publications|University Press|Routledge|Springer|Sage|"
        r"Cambridge|Oxford|Wiley|Elsevier|Palgrave|Editore|Daru|Dâru|Pub\.?|In\s+[A-ZÇĞİÖŞÜ])\b"
    ),
    "journal_like_left": r"(?iu)\b\d+\s*\([^)]{0,25}\)\s*[:,]\s*\d+\s*[-–]\s*\d+|\b\d+\s*[:,]\s*\d+\s*[-–]\s*\d+",
}
CATEGORY_ORDER = (*CATEGORIES, "other")
#: Categories in which a DOI is not to be expected.
DOI_UNLIKELY = ("thesis", "report_policy_legal", "url_web", "book_or_chapter", "dergipark_file")

# Stop words of title tokens; the wider lists add to the first.
STOP_BASE = (
    "and", "the", "for", "with", "from", "into", "using", "based", "study", "analysis", "review",
    "bir", "ve", "ile", "icin", "uzerine", "dergisi", "journal",
)
STOP_WORKS = (*STOP_BASE, "article", "book")
STOP_REPARSE = (*STOP_BASE, "article")
STOP_INDEX = (*STOP_BASE, "article", "için", "üzerine", "international", "university", "universitesi", "üniversitesi")

#: Characters cut from both ends of queries and parts.
TRIM_QUERY = " .;,"
TRIM_PART = " .;:,"
TRIM_DOI = " \t\r\n\"'<>[]{}"
