"""Site profile: the URL and reference patterns of the publications being indexed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SiteProfile:
    """Patterns are Java regexes; group 1 of a URL pattern is the record id."""

    namespace: str
    base_url: str
    alias_pattern: str  # host aliases that are rewritten ...
    alias_target: str  # ... to this host ($n refers to groups)
    attachment_host: str
    direction_url: str
    withdrawn_page: str  # plain substring, case-sensitive
    notification_url: str
    notification_params: tuple[str, ...]  # query parameters holding the id; empty: group 1
    faq_url: str  # FAQ pages as a status lookup knows them
    faq_item: str
    press_release_url: str
    category_url: str
    reference: str  # whole-string textual reference
    header_reference: str
    inline_reference: str
    agency: str  # how its textual references begin


def reference_patterns(agency: str) -> dict[str, str]:
    """The reference patterns of a profile, for references that begin with ``agency``."""
    # Shapes of textual references.
    return {
        "agency": agency,
        "reference": rf"(?iU)^\s*{agency}[/][A-Za-z0-9./\s\-]{{1,200}}\d{{4}}[/\s\-]{{1,5}}\d{{1,10}}\s*$",
        "header_reference": rf"(?U)\b{agency}\s*/\s*[A-Za-z]*\s*/?\s*\d{{4}}\s*[-–]\s*\d{{2,4}}\s*/\s*\d+\b",
        "inline_reference": rf"(?iU){agency}[/\s][A-Za-z0-9./\s\-]+\d{{4}}[/\s\-]+\d+",
    }


# The regulator's public site.
REGULATOR = SiteProfile(
    namespace="rbi",
    base_url="https://www.rbi.org.in/Scripts/",
    alias_pattern=r"^(?:m\.)?rbi\.org\.in$",
    alias_target="www.rbi.org.in",
    attachment_host="rbidocs.rbi.org.in",
    direction_url=r"(?i)BS_ViewMasDirections\.aspx\?id=(\d+)",
    withdrawn_page="NotificationUserWithdrawnCircular.aspx",
    notification_url=r"(?i)NotificationUser\.aspx\?Id=(\d+)",
    notification_params=("Id", "id", "ID"),
    faq_url=r"(?i)FAQ(View|Display)\.aspx",
    faq_item=r"(?i)FAQView\.aspx\?Id=(\d+)",
    press_release_url=r"(?i)BS_PressReleaseDisplay\.aspx\?prid=(\d+)",
    category_url=r"(?i)BS_ViewMasterCirculardetails\.aspx\?did=(\d+)",
    **reference_patterns("RBI"),
)

# Boilerplate attachments and labels, and table header labels.
NOISE_LABELS = ("rbi's vision and values", "accessibility statement")
NOISE_URL_PARTS = ("Utkarsh", "Accessibility20012026")
HEADER_LABELS = ("circular name/title", "subject", "notifications", "circular number", "ref no.")
GENERIC_TITLES = ("frequently asked questions", "faqs")
# Content containers, in order of preference.
DETAIL_CONTAINERS = ("#PageContent", "#contentDiv", "#tablecontainer", "main", ".tablecontainer")
FAQ_CONTAINERS = (
    "#PageContent", "#contentDiv", "#tablecontainer", "#tdmainqry", ".tablecontainer", "main", "#divscroll",
)
