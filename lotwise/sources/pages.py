"""Saved pages as tables: the cards of a list, the facts of one listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import markup as M
from lotwise.functions import text as X

# fixed values: terms of a listing's page and the columns they fill
TERMS = {
    "Город": "page_city", "Поколение": "generation", "Кузов": "page_body", "Объем двигателя, л": "page_engine", "Пробег": "page_mileage", "Коробка передач": "page_transmission", "Привод": "drive",
    "Руль": "steering", "Цвет": "color", "Растаможен в Казахстане": "customs_cleared", "Аварийная": "is_emergency_field", "Состояние": "page_condition", "VIN": "has_vin",
}


def cards(pages: DataFrame, html_col: str = "html", marker: str = "js__a-card", id_attribute: str = "data-id", link: str = "/a/", base: str = "") -> DataFrame:
    """A row for each card of a saved list and the other columns of `pages`; a parser reads each page once.

    The card's columns: ad_id, title, brand, model, price_tenge, spec, city,
    urls, url, photos_count, photo_url, views_count, posted_date, labels,
    is_vip, has_monthly_price.  A card ends with its element, or before, where
    the next begins.  Pictures are previews in whole size, each once; static
    artwork is left out.  The specification falls back to a picture's `alt`.
    Columns of `pages` with these names give way.  Pages without cards, null and
    empty ones have no rows; `is_listing` tells cards of listings from others.
    """
    rows = pages.withColumn("_card", F.explode(M.parsed(F.col(html_col), M.card_list, M.CARD, marker, id_attribute, link)))
    card = F.col("_card")
    previews = F.filter(card["pictures"], lambda u: ~F.contains(u, F.lit("/static/")))
    urls = F.array_distinct(F.transform(previews, X.full_size))
    href = F.coalesce(X.blank_to_null(X.without_query(card["href"])), F.concat(F.lit(link), card["ad_id"]))
    known = {
        "ad_id": X.blank_to_null(card["ad_id"]), "title": X.blank_to_null(card["title"]), "_bm": X.brand_model(card["title"]), "price_tenge": X.clean_int(card["price"]), "spec": X.spec_line(card["description"]), "city": X.blank_to_null(card["city"]),
        "urls": urls, "url": F.concat(F.lit(base), href), "views_count": X.clean_int(card["views"]), "posted_date": X.blank_to_null(card["posted"]), "labels": X.blank_to_null(F.array_join(card["labels"], "|")),
        "is_vip": card["is_vip"].cast("int"), "has_monthly_price": card["has_monthly_price"].cast("int"), "_n": X.clean_int(card["picture_count"]),
    }
    out = rows.select(*[c for c in pages.columns if c != html_col and c not in known], *[c.alias(name) for name, c in known.items()])
    counts = {"photos_count": F.greatest(F.coalesce("_n", F.lit(0)), F.size("urls"), F.lit(1)).cast("int"), "photo_url": F.coalesce(F.get("urls", F.lit(0)), F.lit(""))}
    return out.withColumns({"brand": F.col("_bm.brand"), "model": F.col("_bm.model")} | counts).drop("_bm", "_n")


def is_listing() -> Column:
    """Whether a card has an id, a title and a price; others are advertising or placeholders."""
    return F.col("ad_id").isNotNull() & F.col("title").isNotNull() & (F.coalesce("price_tenge", F.lit(0)) > 0)


def listing_pages(pages: DataFrame, html_col: str = "html", terms: dict[str, str] = TERMS, badge: str = "offer__parameters-mortgaged") -> DataFrame:
    """The facts of saved listing pages, one row for each page; the html goes.

    Terms, heading, options and badge come from one parse; words for damage are
    sought in heading, options and comment.  Null and empty pages have nulls,
    empty texts and the badge '-'.
    """
    html = F.col(html_col)
    comment = X.json_text(html, "descriptionText")
    # the comment is cut out before the parser's column, so that the html is read by both and goes no further
    rows = pages.withColumns({"_facts": M.parsed(html, M.facts, M.FACTS, badge), "seller_comment": comment})
    own = F.col("_facts")
    facts = {name: F.try_element_at(own["terms"], F.lit(term)) for term, name in terms.items()}
    sought = F.concat_ws(" ", own["h1"], own["options_text"], F.col("seller_comment"))
    more = {
        "page_mileage_km": X.clean_int(F.try_element_at(own["terms"], F.lit("Пробег"))).cast("int") if "Пробег" in terms else F.lit(None).cast("int"),
        "options_text": F.substring(own["options_text"], 1, 800),
        "market_price": F.coalesce(X.json_number(html, "avgPrice"), F.lit(-1)),
        "page_status_badge": own["badge"],
        "damage_keywords": F.array_join(X.lexicon_hits(sought, X.DAMAGE), "|"),
        "is_archived": X.is_archived(html).cast("int"),
        "is_blocked": X.is_blocked(html).cast("int"),
    }
    return rows.withColumns(facts | more).drop("_facts", html_col)


def outlines(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """title, h1, footer, links, paragraphs and text_chars of each page, in place of columns of these names; the html goes.

    Null and empty pages have no title, heading and footer, and zeros.
    """
    rows = pages.withColumn("_outline", M.parsed(F.col(html_col), M.outline, M.OUTLINE))
    names = ["title", "h1", "footer", "links", "paragraphs", "text_chars"]
    return rows.withColumns({n: F.col("_outline")[n] for n in names}).drop("_outline", html_col)
