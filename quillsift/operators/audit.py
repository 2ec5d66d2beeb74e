"""Spam or phishing: an ordered ladder of checks over subject, sender name, body and links."""

from __future__ import annotations

import re
from functools import reduce
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import normalize_homoglyphs
from quillsift.functions.urls import domain_root

# ---- fixed values

#: Brands in order of matching, and the domains that own them.
BRAND_DOMAINS = {
    "microsoft": "microsoft.com outlook.com live.com office.com office365.com msn.com",
    "office365": "microsoft.com outlook.com office.com office365.com",
    "outlook": "microsoft.com outlook.com live.com",
    "apple": "apple.com icloud.com",
    "icloud": "apple.com icloud.com",
    "amazon": "amazon.com amazon.co.uk amazon.de amazon.fr amazon.ca amazon.it amazon.es",
    "paypal": "paypal.com",
    "netflix": "netflix.com",
    "google": "google.com gmail.com",
    "gmail": "google.com gmail.com",
    "facebook": "facebook.com fb.com meta.com",
    "instagram": "instagram.com facebook.com meta.com",
    "whatsapp": "whatsapp.com facebook.com meta.com",
    "bank of america": "bankofamerica.com",
    "wells fargo": "wellsfargo.com",
    "chase": "chase.com jpmorgan.com",
    "banco do brasil": "bb.com.br",
    "bradesco": "bradesco.com.br",
    "itau": "itau.com.br",
    "santander": "santander.com santander.com.br",
    "hsbc": "hsbc.com",
    "dhl": "dhl.com",
    "fedex": "fedex.com",
    "ups": "ups.com",
    "usps": "usps.com",
    "correios": "correios.com.br",
    "docusign": "docusign.com docusign.net",
    "adobe": "adobe.com",
    "linkedin": "linkedin.com",
    "coinbase": "coinbase.com",
    "binance": "binance.com",
    "ripple": "ripple.com",
    "coinbase.com": "coinbase.com",
    "protonmail": "protonmail.com proton.me",
    "proton mail": "protonmail.com proton.me",
    "chase bank": "chase.com",
    "irs": "irs.gov",
    "ebay": "ebay.com",
    "steam": "steampowered.com steamcommunity.com",
    "spotify": "spotify.com",
    "zoom": "zoom.us",
    "att": "att.com",
    "verizon": "verizon.com",
    "t-mobile": "t-mobile.com",
    "visa": "visa.com",
    "mastercard": "mastercard.com",
    "american express": "americanexpress.com aexp.com",
    "amex": "americanexpress.com aexp.com",
    "mcafee": "mcafee.com",
    "metamask": "metamask.io",
    "ledger": "ledger.com",
    "trust wallet": "trustwallet.com",
    "kraken": "kraken.com",
    "crypto.com": "crypto.com",
    "norton": "norton.com nortonlifelock.com",
    "irs.gov": "irs.gov",
    "usps.com": "usps.com",
    "royal mail": "royalmail.com",
    "la poste": "laposte.fr",
    "mercado pago": "mercadopago.com mercadopago.br mercadolibre.com",
    "mercado libre": "mercadolibre.com mercadopago.com",
    "nubank": "nubank.com.br",
    "caixa": "caixa.gov.br",
}
SPAM_TOPICS = (
    r"\bhorosc|astrolog|zodiac|tarot|voyance|psychic\b",
    r"\bviagra|cialis|erectile|e\.?d\.? (by age|treatment|pills)|libido|weight ?loss|detox|slim(ming)?|keto\b",
    r"\bdating|singles? (near|in) you|hot (girls|singles)|adult (content|dating)|xxx|milf|cam ?girl|ragazz|penis|breast selection\b",
    r"\bcasino|slots?|jackpot|free ?spins?|no deposit\b",
    r"\blanguage course|learn (spanish|english|german|french)|speak fluent\b",
    r"\bcooking class|recipe of the (day|week)|meal kit\b",
    r"\bcash ?back|swagbucks|earn money online|make money (fast|online)|work from home\b",
    r"\bnewsletter|unsubscribe|opt.?out|marketing preferences\b",
    r"\bmortgage rates?|refinance your (home|loan)|debt relief\b",
    r"\bpharmacy|prescription drugs? online\b",
    r"\bcbd oil|supplement|anti.?aging|wrinkle|muskelaufbau|muskelwachstum|anaboloxan\b",
    r"\bfree tv|streaming subscription|iptv\b",
    r"\bsolar panel|home warranty|car insurance quote\b",
    r"\byou('| ha)ve won\b|claim your (prize|bonus|gift|reward)\b|gutschein|geschenk gewonnen|gewonnen!|hebt gewonnen|je hebt gewonnen"
    r"|congratulations you('| ha)ve been selected|selected to receive|complete (this|our|the) (short )?survey|take (this|our) survey"
    r"|prijs gewonnen|noodpakket gewonnen\b",
)
SCAM = (
    r"\b(next of kin|inheritance|beneficiary|deposit box|unclaimed fund|foreign partner|dying wish|widow of|humanitarian gesture"
    r"|transfer (the|your) (fund|money)|million (dollars|usd|euros)\b.{0,40}\b(deposit|transfer|inherit))"
)
CREDENTIAL = (
    r"\bverify your (account|identity|password|payment|billing)\b",
    r"\bconfirm your (account|identity|password|payment method|billing)\b",
    r"\b(account|payment) (has been )?(suspended|locked|limited|restricted|on hold)\b",
    r"\bunusual (sign.?in|login) activity\b",
    r"\bsuspicious (activity|login) detected\b",
    r"\b(someone|a user|new device) (tried to|just)?\s*log(ged)? ?in to your account\b",
    r"\bnew device.{0,20}logged into your\b",
    r"\bupdate your (payment|billing) (information|details|method)\b",
    r"\bre.?enter your (password|credentials|card details)\b",
    r"\byour password (will|is about to) expire\b",
    r"\benter your (pin|password|otp|verification code|security code)\b",
    r"\bconfirm your (card|bank) details\b",
    r"\bsign in to (avoid|prevent|restore)\b",
    r"\baction required.{0,30}account\b",
    r"\byour (account|mailbox) (will be|has been) (deactivated|deleted|closed)\b",
    r"\bclick to (unlock|reactivate|restore) your account\b",
    r"\b(schutz|protection|subscription|abonnement|antivirus) (ist |is )?(abgelaufen|expired)\b",
    r"\bger[äa]te (jetzt |now )?(ungeschützt|unprotected)\b",
    r"\brenew (your )?(subscription|protection|antivirus)\b",
    r"\b(suspens[ãa]o|suspensão) d[ae] (cnh|cpf|conta)\b",
    r"\bcpf (com status |está )?suspens",
    r"\bdívida ativa detectada\b",
    r"\bbloqueio iminente\b",
    r"\bregularize (a )?(sua )?situa[çc][ãa]o\b",
    r"\bprocesso de suspens[ãa]o\b",
)
BOILERPLATE = (
    r"\bconfirm your (subscription|newsletter|email address to (continue receiving|subscribe))\b|\bverify (you'?re human|you are human|your (age|interest))\b"
    r"|\bconfirm your registration\b|\bclick (here|below) to (activate your account|confirm your (inscription|subscription))\b"
)
MARKETING = r"\bunsubscribe|% off|discount code|promo code|limited time offer|free shipping|shop now|new arrivals|flash sale\b"
URGENT = ("24 hours", "expire", "expires", "expiring", "immediately", "urgent", "final notice", "last chance", "act now", "suspended", "locked", "unusual activity", "verify now", "restricted")

# ---- end of fixed values

REASONS = ("brand_impersonation", "credential_request", "advance_fee", "urgency_and_link", "spam_topic", "boilerplate_confirm", "unspecific_credential", "marketing", "low_signal", "default_phishing")


_W = "(?-iu:[0-9A-Za-z_])"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def _ascii(pattern: str, flags: str) -> str:
    """A pattern as SQL engines on RE2 read it: words are ASCII, and a dot takes all but \\n."""
    return f"(?{flags}d)" + pattern.replace(r"\b", _EDGE)


def _top_level(pattern: str) -> list[str]:
    """The alternatives of a pattern that stand outside of all groups."""
    out, depth = [""], 0
    for token in re.findall(r"\\.|\[[^\]]*\]|.", pattern):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            out.append("")
        else:
            out[-1] += token
    return out


def _needed(parsed) -> list[str]:
    """Lower-case ASCII strings of which every match of a parsed pattern holds one; empty if none is known."""
    runs, found = [""], []
    for op, value in parsed:
        kind = str(op)
        if kind == "LITERAL" and value < 128:
            runs[-1] += chr(value).lower()
            continue
        runs.append("")
        if kind == "SUBPATTERN":
            found.append(_needed(value[3]))
        elif kind == "BRANCH":
            each = [_needed(branch) for branch in value[1]]
            found.append(sum(each, []) if all(each) else [])
        elif kind == "MAX_REPEAT" and value[0] > 0:
            found.append(_needed(value[2]))
    found = [f for f in [*([r] for r in runs if r), *found] if f]
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=[])


def _swapped(text: Column, letters: str, others: str) -> Column:
    """translate for rare letters: texts without them are let through."""
    return F.when(reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in letters]), F.translate(text, letters, others)).otherwise(text)


def _plain(text: Column, ascii_words: bool) -> Column:
    """(?iu) alone takes these two letters for an i."""
    return _swapped(text, "\u0131\u0130", "\u00e9\u00e9") if ascii_words else text


def _hit(text: Column, folded: Column, pattern: str, ascii_words: bool) -> Column:
    """Whether a pattern is found in _plain text; its _folded form is searched for each alternative's strings first."""
    # elements of arrays, as a long chain of ORs is too deep to be compiled
    any_of = lambda columns: reduce(lambda x, y: x | y, columns) if len(columns) < 4 else F.array_contains(F.array(*columns), True)
    found = []
    for part in _top_level(pattern):
        strings = any_of([F.contains(folded, F.lit(n)) for n in _needed(regex_parser.parse(part)) or [""]])
        found.append(strings & text.rlike(_ascii(part, "iu") if ascii_words else "(?iuU)" + part))
    return any_of(found)


def _folded(text: Column, ascii_words: bool) -> Column:
    """Lower case, with a plain letter for those beyond ASCII that _hit takes for one."""
    return F.lower(_swapped(text, "\u0131\u0130\u017f", "\u00e9\u00e9s" if ascii_words else "iis"))


def _lower(text: Column, ascii_words: bool) -> Column:
    return F.lower(_swapped(text, "\u0130", "i")) if ascii_words else F.lower(text)


_LOOKALIKES = str.maketrans("l10534@", "iioseaa")


def _brand_words(low: Column, brands: list[str]) -> Column:
    """The ASCII words of a text that are the longest word of a brand."""
    return F.array_intersect(F.split(low, "[^0-9A-Za-z_]+"), F.array(*[F.lit(w) for w in sorted(set(map(_longest, brands)))]))


def _longest(brand: str) -> str:
    return max(re.findall("[0-9A-Za-z_]+", brand), key=len)


def brand_hit(text: Column, from_domain: Column, ascii_words: bool = False, words: tuple[Column, Column] | None = None) -> Column:
    """The first brand named as a word in text, look-alike characters included, that the sender's domain does not own.

    words: _brand_words of the lower-cased text and of its look-alike form; a brand is only looked for where its word stands.
    """
    low = _lower(F.coalesce(text, F.lit("")), ascii_words)
    norm = normalize_homoglyphs(low)
    root = domain_root(from_domain)

    def word(t: Column, b: str, i: int) -> Column:
        if not ascii_words:
            return t.rlike(rf"(?iuU)\b{re.escape(b)}\b")
        found = t.rlike(_ascii(rf"\b{re.escape(b)}\b", ""))
        if words is None:
            return found
        here = F.array_contains(words[i], _longest(b))
        return here if _longest(b) == b else here & found

    found = []
    for brand, domains in BRAND_DOMAINS.items():
        roots = sorted({".".join(d.split(".")[-2:]) for d in domains.split()})
        named = word(low, brand, 0) | word(norm, brand.translate(_LOOKALIKES), 1)
        found.append(F.when(named & ~F.coalesce(root.isin(roots), F.lit(False)), F.lit(brand)))
    return F.get(F.filter(F.array(*found), lambda b: b.isNotNull()), F.lit(0))


def classify(df: DataFrame, ascii_words: bool = False) -> DataFrame:
    """df with likely_spam and spam_reason (one of REASONS), and brand for the first.

    Bodies are read whole. Words end where Unicode ends them ("itauö" is one word, and no brand), or with ascii_words at every letter beyond ASCII.
    Reads subject, display_name, from_domain, body_text, n_urls, claims_attachment, credential_request, urgency (array of keywords).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat_ws(" ", text("subject"), text("display_name"))
    topics, asks = "|".join(SPAM_TOPICS), "|".join(CREDENTIAL)
    out = df.withColumn("_h", head).withColumn("_s", text("body_text"))
    h, s, w = F.col("_h"), F.col("_s"), F.col("_w")
    out = out.withColumn("_w", _plain(F.concat_ws(" ", h, s), ascii_words)).withColumn("_n", _plain(normalize_homoglyphs(_lower(h, ascii_words)), ascii_words))
    # head and body apart: no pattern passes a line feed
    out = out.withColumn("_t", _plain(F.concat_ws("\n", h, s), ascii_words)).withColumn("_f", _folded(w, ascii_words)).withColumn("_nf", _folded(F.col("_n"), ascii_words))
    hit = lambda t, pattern, folded="_f": _hit(F.col(t), F.col(folded), pattern, ascii_words)
    words: dict[str, tuple[Column, Column] | None] = {"_h": None, "_s": None}
    if ascii_words:
        for c in words:
            low = _lower(F.col(c), True)
            out = out.withColumn(f"{c}_low", _brand_words(low, list(BRAND_DOMAINS))).withColumn(f"{c}_alike", _brand_words(normalize_homoglyphs(low), [b.translate(_LOOKALIKES) for b in BRAND_DOMAINS]))
            words[c] = F.col(f"{c}_low"), F.col(f"{c}_alike")
    brand = F.coalesce(*[brand_hit(F.col(c), F.col("from_domain"), ascii_words, words[c]) for c in words])
    out = out.withColumn("brand", brand).withColumn("_topic", hit("_t", topics)).withColumn("_ask", hit("_t", asks) | hit("_n", asks, "_nf"))
    topic, ask, branded = F.col("_topic"), F.col("_ask"), F.col("brand").isNotNull()
    link = F.coalesce(F.col("n_urls") > 0, F.lit(False))
    asked = F.coalesce(F.col("credential_request"), F.lit(False))
    claims = F.coalesce(F.col("claims_attachment"), F.lit(False))
    urgent = F.coalesce(F.transform("urgency", F.lower), F.array().cast("array<string>"))
    pressed = F.arrays_overlap(urgent, F.array(*map(F.lit, URGENT)))
    ladder = (
        F.when(branded, REASONS[0]).when(ask & ~topic, REASONS[1]).when(hit("_w", SCAM), REASONS[2])
        .when(pressed & link & ~topic & F.col("claims_attachment").isNotNull(), REASONS[3]).when(topic, REASONS[4])
        .when(asked & hit("_w", BOILERPLATE) & ~ask, REASONS[5]).when(asked & ~ask, REASONS[6]).when(hit("_w", MARKETING) & ~ask, REASONS[7])
        .when(~link & ~claims & (F.size(urgent) == 0), REASONS[8]).otherwise(REASONS[9])
    )
    out = out.withColumn("spam_reason", ladder)
    return out.withColumn("likely_spam", F.col("spam_reason").isin(*REASONS[4:9])).drop("_h", "_s", "_w", "_n", "_t", "_f", "_nf", "_h_low", "_h_alike", "_s_low", "_s_alike", "_topic", "_ask")


def top_spam_domains(audited: DataFrame, n: int = 20) -> DataFrame:
    """The n domains with most likely spam, with totals."""
    return audited.groupBy("from_domain").agg(F.count_if("likely_spam").alias("spam"), F.count("*").alias("total")).filter("spam > 0").orderBy(F.desc("spam"), "from_domain").limit(n)
