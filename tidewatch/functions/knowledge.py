"""What the engine knows about brands, domains, addresses, words and manipulation patterns.

Everything in this module is a fixed value that results depend on: word lists, lookup tables and patterns, in their
given order (the order decides which brand or tactic comes first).  Patterns are written in the common dialect that
functions.rx turns into Java's.
"""

# fmt: off
# Brands: name, keywords, official domains.
BRANDS = (
    ("Google", ("google", "gmail", "google drive", "google docs"), ("google.com", "gmail.com", "googlemail.com", "google.co.in", "youtube.com")),
    ("Microsoft", ("microsoft", "outlook", "office365", "office 365", "onedrive", "sharepoint", "windows"), ("microsoft.com", "outlook.com", "live.com", "office.com", "microsoftonline.com", "sharepoint.com", "hotmail.com")),
    ("Apple", ("apple", "icloud", "apple id", "appleid", "itunes"), ("apple.com", "icloud.com")),
    ("Amazon", ("amazon", "aws", "prime video"), ("amazon.com", "amazon.in", "aws.amazon.com", "amazonaws.com")),
    ("Facebook / Meta", ("facebook", "meta", "instagram", "whatsapp"), ("facebook.com", "meta.com", "instagram.com", "whatsapp.com", "fb.com")),
    ("Netflix", ("netflix",), ("netflix.com",)),
    ("PayPal", ("paypal",), ("paypal.com",)),
    ("LinkedIn", ("linkedin",), ("linkedin.com",)),
    ("DHL", ("dhl",), ("dhl.com",)),
    ("FedEx", ("fedex",), ("fedex.com",)),
    ("India Post", ("india post", "indiapost"), ("indiapost.gov.in",)),
    ("Blue Dart", ("bluedart", "blue dart"), ("bluedart.com",)),
    ("State Bank of India", ("sbi", "state bank", "yono", "onlinesbi"), ("sbi.co.in", "onlinesbi.sbi", "onlinesbi.com")),
    ("HDFC Bank", ("hdfc",), ("hdfcbank.com",)),
    ("ICICI Bank", ("icici",), ("icicibank.com",)),
    ("Axis Bank", ("axis bank", "axisbank"), ("axisbank.com",)),
    ("Kotak Mahindra Bank", ("kotak",), ("kotak.com",)),
    ("Punjab National Bank", ("pnb", "punjab national"), ("pnbindia.in",)),
    ("Paytm", ("paytm",), ("paytm.com", "paytmbank.com")),
    ("PhonePe", ("phonepe",), ("phonepe.com",)),
    ("Google Pay / UPI", ("google pay", "gpay", "upi", "npci", "bhim"), ("pay.google.com", "npci.org.in", "bhimupi.org.in")),
    ("Income Tax Department (India)", ("income tax", "incometax", "itr refund", "cbdt"), ("incometax.gov.in", "incometaxindia.gov.in")),
    ("GST / CBIC", ("gst", "gstn", "cbic"), ("gst.gov.in",)),
    ("UIDAI / Aadhaar", ("aadhaar", "aadhar", "uidai"), ("uidai.gov.in",)),
    ("EPFO", ("epfo", "provident fund", "uan"), ("epfindia.gov.in",)),
    ("IRCTC", ("irctc",), ("irctc.co.in",)),
    ("Flipkart", ("flipkart",), ("flipkart.com",)),
    ("Myntra", ("myntra",), ("myntra.com",)),
    ("Swiggy", ("swiggy",), ("swiggy.com",)),
    ("Zomato", ("zomato",), ("zomato.com",)),
    ("Reserve Bank of India", ("rbi", "reserve bank"), ("rbi.org.in",)),
    ("Binance", ("binance",), ("binance.com",)),
    ("Coinbase", ("coinbase",), ("coinbase.com",)),
    ("WazirX", ("wazirx",), ("wazirx.com",)),
    ("Steam", ("steam", "steamcommunity"), ("steampowered.com", "steamcommunity.com")),
    ("GitHub", ("github",), ("github.com",)),
    ("DocuSign", ("docusign",), ("docusign.com", "docusign.net")),
    ("Zoom", ("zoom meeting", "zoom.us"), ("zoom.us",)),
    ("Telegram", ("telegram",), ("telegram.org", "t.me")),
    ("Uber", ("uber",), ("uber.com",)),
    ("Ola", ("olacabs", "ola cabs"), ("olacabs.com",)),
    ("Airtel", ("airtel",), ("airtel.in",)),
    ("Jio", ("jio", "reliance jio"), ("jio.com",)),
    ("Vodafone Idea", ("vodafone", " vi "), ("myvi.in",)),
    ("BSNL", ("bsnl",), ("bsnl.co.in",)),
)

# Reputable domains besides the brands' own.
OTHER_TRUSTED_DOMAINS = (
    "wikipedia.org", "stackoverflow.com", "stackexchange.com", "mozilla.org", "w3.org", "nic.in", "gov.in", "mygov.in", "digilocker.gov.in",
    "india.gov.in", "sih.gov.in", "npmjs.com", "nodejs.org", "python.org", "developer.mozilla.org", "cloudflare.com", "atlassian.com",
    "slack.com", "notion.so", "figma.com", "dropbox.com", "adobe.com", "ieee.org", "acm.org", "coursera.org", "udemy.com", "nptel.ac.in",
    "aicte-india.org",
)
FREE_MAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "ymail.com", "rediffmail.com", "hotmail.com", "outlook.com", "live.com",
    "aol.com", "gmx.com", "mail.com", "zoho.com", "yandex.com", "protonmail.com", "proton.me", "icloud.com", "inbox.lv",
)
DISPOSABLE_MAIL_DOMAINS = (
    "mailinator.com", "guerrillamail.com", "sharklasers.com", "10minutemail.com", "tempmail.com", "temp-mail.org", "yopmail.com",
    "trashmail.com", "dispostable.com", "getnada.com", "throwawaymail.com", "maildrop.cc", "fakeinbox.com", "mailnesia.com", "moakt.com",
)
URL_SHORTENERS = (
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do", "cutt.ly", "shorte.st", "rb.gy",
    "rebrand.ly", "tiny.cc", "lnkd.in", "shorturl.at", "urlz.fr", "v.gd", "x.co", "clck.ru", "soo.gd", "s2r.co", "qps.ru", "trib.al",
    "zpr.io", "shrtco.de", "gg.gg", "me2.do", "chilp.it", "clicky.me", "linktr.ee", "rebrandly.com", "short.gy", "tny.im", "urlis.net",
    "kutt.it",
)
SUSPICIOUS_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "top", "xyz", "club", "work", "click", "link", "live", "buzz", "rest", "fit", "surf", "cam", "monster",
    "quest", "cyou", "icu", "zip", "mov", "country", "kim", "review", "date", "wang", "loan", "racing", "stream", "download", "bid",
    "trade", "party", "gdn", "mom", "lol", "pw", "cc", "su", "ru.com", "sbs", "autos", "boats", "bar", "best", "casa", "cfd", "shop.ru",
)
FREE_HOSTING_HOSTS = (
    "blogspot.com", "wordpress.com", "weebly.com", "wixsite.com", "webnode.page", "jimdofree.com", "000webhostapp.com",
    "infinityfreeapp.com", "epizy.com", "byethost.com", "hostinger.site", "github.io", "gitlab.io", "netlify.app", "vercel.app",
    "pages.dev", "workers.dev", "r2.dev", "firebaseapp.com", "web.app", "glitch.me", "repl.co", "replit.dev", "herokuapp.com", "ngrok.io",
    "ngrok-free.app", "trycloudflare.com", "loca.lt", "serveo.net", "localtunnel.me", "duckdns.org", "no-ip.org", "ddns.net", "hopto.org",
    "zapto.org", "sytes.net", "sites.google.com", "forms.gle", "docs.google.com/forms", "formspree.io", "jotform.com", "typeform.com",
    "surveyheart.com", "pastebin.com", "anotepad.com", "telegra.ph", "ipfs.io", "dweb.link", "cloudfront.net", "blob.core.windows.net",
    "s3.amazonaws.com", "godaddysites.com", "square.site", "canva.site", "notion.site", "framer.website",
)
MULTI_PART_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "sch.uk", "co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in", "gov.in",
    "nic.in", "ac.in", "edu.in", "res.in", "mil.in", "com.au", "net.au", "org.au", "gov.au", "edu.au", "co.jp", "or.jp", "ne.jp", "ac.jp",
    "go.jp", "com.br", "net.br", "org.br", "gov.br", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "co.za", "org.za", "gov.za",
    "com.sg", "com.my", "com.ph", "com.pk", "com.bd", "com.np", "co.nz", "org.nz", "govt.nz", "com.tr", "com.mx", "com.ar", "com.co",
    "com.pe", "co.kr", "or.kr", "go.kr", "com.hk", "com.tw", "co.il", "co.th", "in.th", "com.sa", "com.eg", "com.ng", "co.ke", "com.gh",
    "com.ua", "com.ru", "org.ru", "com.vn", "co.id", "or.id", "go.id", "ac.id", "sch.id",
)
DANGEROUS_EXTENSIONS = (
    "exe", "scr", "bat", "cmd", "com", "pif", "vbs", "vbe", "js", "jse", "wsf", "wsh", "msi", "msp", "hta", "cpl", "jar", "apk", "dmg",
    "iso", "img", "lnk", "ps1", "reg", "ace", "cab", "docm", "xlsm", "pptm", "dotm", "xlam", "svg", "html", "htm", "shtml", "chm",
)
REDIRECT_PARAMS = (
    "url", "redirect", "redirect_uri", "redirecturl", "return", "returnurl", "next", "continue", "dest", "destination", "goto", "target",
    "r", "u", "link", "out", "forward", "redir",
)
IDENTITY_PARAMS = (
    "email", "mail", "user", "username", "userid", "login", "account", "acct", "card", "cardno", "cvv", "pin", "otp", "password", "passwd",
    "pwd", "token", "aadhaar", "pan", "ifsc", "upi", "vpa", "mobile", "phone",
)
HIGH_RISK_EXTENSIONS = (
    "exe", "scr", "apk", "msi", "jar", "vbs", "js", "hta", "bat", "cmd", "ps1", "lnk",
)
CREDENTIAL_PATH_WORDS = (
    "login", "signin", "sign-in", "logon", "account", "accounts", "verify", "verification", "validate", "secure", "security", "update",
    "confirm", "auth", "authenticate", "password", "passwd", "credential", "recover", "unlock", "reactivate", "suspended", "billing",
    "payment", "wallet", "netbanking", "banking", "kyc", "aadhaar", "pan", "upi", "otp", "webscr", "cmd", "dispatch", "session", "token",
    "invoice", "refund", "claim", "reward", "gift", "prize", "winner",
)
CREDENTIAL_FIELD_NAMES = (
    "pass", "pwd", "password", "passwd", "passcode", "pin", "mpin", "otp", "cvv", "cvc", "card", "cardno", "cardnumber", "expiry",
    "aadhaar", "aadhar", "pan", "ifsc", "upi", "vpa", "ssn", "dob", "mmn", "seed", "mnemonic", "privatekey",
)
SENSITIVE_TOPICS = (
    "password", "otp", "cvv", "pin", "aadhaar", "aadhar", "pan card", "ifsc", "upi", "net banking", "netbanking", "credit card",
    "debit card", "bank account", "kyc", "wallet", "seed phrase", "private key", "salary", "invoice", "refund", "payment",
)
# Look-alike letters and what they look like, place by place.
HOMOGLYPHS_FROM = "аеорсхуіѕԁһνορταεικμѵàáâäåãèéêëìíîïòóôöõøùúûüçñýłĺǀẹọạḅḍṇṣṭ\u0131"
HOMOGLYPHS_TO = "aeopcxyisdhvoptaeikmvaaaaaaeeeeiiiioooooouuuucnyllleoabdnsti"
LEET_FROM = "01345789$@!|¡"
LEET_TO = "oleastbgsaili"

# Tactics: id, category, weight, weight of a repeat, cap, patterns (any case).
TACTICS = (
    ("urgency", "social-engineering", 13, 4, 25, (
        r"\b(within|in)\s+\d{1,2}\s*(hours?|hrs?|minutes?|mins?|days?)\b[^.!?]{0,70}\b(or\b|otherwise|else\b|to avoid|verify|confirm|update|pay|click|respond|reply|submit|suspend|block|deactivat|clos|terminat|cancel|expire|delet|penalt|legal)",
        r"\b(verify|confirm|update|pay|click|respond|reply|submit|act|complete|renew|claim)\b[^.!?]{0,50}\b(within|in|before)\s+\d{1,2}\s*(hours?|hrs?|minutes?|mins?|days?)\b",
        r"\b(immediate(ly)?|urgent(ly)?|right away|as soon as possible|asap|at once|without delay)\b",
        r"\b(act|respond|reply|confirm|verify|update|click|pay|redeem)\s+(now|immediately|today|fast|quickly|at once)\b",
        r"\b(last|final)\s+(chance|warning|reminder|notice|opportunity)\b",
        r"\b(expires?|expiring|expired|valid (only )?(for|till|until))\s+(today|tonight|tomorrow|soon|in\s+\d{1,2}\s*(minutes?|mins?|hours?|hrs?))",
        r"\b(time[-\s]?sensitive|limited time|hurry|don'?t delay|before it'?s too late|only \d+ (left|remaining))\b",
        r"\b(within|in)\s+(24|48|72)\s*(hours?|hrs?)\b[^.!?]{0,60}\b(or|otherwise|to avoid|verify|confirm|update|pay|suspend|block|deactivat|clos)",
        r"\b(suspend|block|deactivat|disabl|terminat|clos|lock|freez|restrict|expir|delet|cancel|forfeit|disconnect|remov)\w*\b[^.!?]{0,45}\b(within|in)\s+(\d{1,2}\s*(hours?|hrs?|minutes?|mins?)|[1-3]\s*days?)\b",
    )),
    ("fear", "social-engineering", 15, 5, 28, (
        r"\b(suspend(ed|ing)?|block(ed|ing)?|deactivat(e|ed|ion)|disabl(e|ed)|disconnect(ed|ion)?|terminat(e|ed|ion)|clos(e|ed|ure)|lock(ed)?|freez(e|ing|ed)|restrict(ed|ion)|withheld|laps(e|ed)|dormant|removed)\b[^.!?]{0,40}\b(account|card|profile|access|service|number|sim|wallet|policy|connection|meter|result|marksheet|admission)\b",
        r"\b(account|card|sim|policy|connection|meter|number)\b[^.!?]{0,30}\b(will be|shall be|is going to be)\b[^.!?]{0,25}\b(disconnect|remov|cancel|withheld|forfeit)",
        r"\b(account|card|sim|kyc|wallet|profile)\b[^.!?]{0,40}\b(will be|shall be|is going to be|about to be)\b[^.!?]{0,20}\b(suspend|block|deactivat|clos|terminat|lock|freez|expire)",
        r"\b(unauthorized|unusual|suspicious|unrecognized)\s+(login|sign[-\s]?in|access|activity|transaction|attempt|device)\b",
        r"\b(legal action|police|court|arrest|fir|cyber cell|lawsuit|penalty|fine|prosecut)",
        r"\b(you (will|may) lose|permanent(ly)? (delet|los|clos)|data will be (erased|deleted)|avoid (suspension|deactivation|penalty))",
        r"\b(virus|malware|trojan|infected|hacked|compromised|breach)\b",
        r"\b(failed|declined|rejected)\s+(payment|transaction|delivery|attempt)\b",
    )),
    ("authority", "social-engineering", 12, 4, 22, (
        r"\b(this is|i am|on behalf of)\s+(the\s+)?(ceo|cfo|coo|md|managing director|director|manager|hr|head of|principal|dean|chairman)",
        r"\b(income tax|it department|gst|cbdt|cbic|uidai|aadhaar|epfo|rbi|reserve bank|npci|trai|police|cyber (cell|crime)|customs|court)\b[^.!?]{0,50}\b(notice|action|verify|update|payment|penalty|department|officer)\b",
        r"\b(security team|fraud (department|team)|compliance (team|department)|account (security|services) team|it (support|helpdesk|department))\b[^.!?]{0,60}\b(requires?|require|needs?|asks?|request(s|ing)?|has (detected|blocked|flagged)|contact us|call us|reply|verify|confirm|click|share|provide|submit)",
        r"\b(i am|this is|calling from|on behalf of)\b[^.!?]{0,30}\b(security team|fraud (department|team)|customer (care|support)|helpdesk|bank)\b",
        r"\b(official (notice|communication|warning)|government of india|ministry of)\b",
        r"\b(your (bank|branch) manager|bank official|authorized (officer|representative))\b",
    )),
    ("credential-request", "credential-theft", 20, 6, 34, (
        r"(?<!\bnot )(?<!\bnever )(?<!\bnot to )(?<!\bdont )\b(enter|provide|submit|confirm|share|send|update|re-?enter|validate|verify|reply with|revert with|fill in|furnish|disclose|quote)(?:s|d|ed|ing)?\b[^.!?]{0,45}\b(password|passcode|pin|otp|one[-\s]?time (password|code)|cvv|card (number|details)|credit card|debit card|net ?banking|user ?id|username|login (details|credentials)|credentials|aadhaar|aadhar|pan (number|card)|ifsc|upi (pin|id)|account (number|details)|cancelled cheque|date of birth|mother'?s maiden)",
        r"\b(forward|send|share|tell|read out|give)(?:s|d|ed|ing)?\b[^.!?]{0,35}\b(\d\s*digit\s*)?(code|otp|password|pin)\b[^.!?]{0,30}\b(you (just )?received|sent to (you|your)|on your (phone|mobile)|so i can|to complete|to confirm)",
        r"\b(password|otp|cvv|pin|mpin|upi pin)\b[^.!?]{0,25}\b(expire|expired|reset|change|required|needed|verify|confirm)\b",
        r"\b(verify|confirm|update|re-?activate|reactivate|restore|revalidate|re-?register)(?:s|d|ed|ing)?\b[^.!?]{0,30}\b(your )?(account|identity|kyc|profile|details|information|billing|payment method|user ?id|net ?banking)\b",
        r"\b(scan)(?:s|ned|ning)?\b[^.!?]{0,30}\bqr\b[^.!?]{0,40}\b(receive|get|claim|collect|credit|refund|cashback|money|amount)",
        r"\b(enter|share|confirm)(?:s|d|ed|ing)?\s+(your\s+)?upi\s*pin\b",
        r"\b(log ?in|sign ?in)\b[^.!?]{0,30}\b(to (verify|confirm|restore|avoid|update)|immediately|here|below|using the link)",
        r"\b(do not share|never share)\b[^.!?]{0,20}\bthis (otp|code)\b[^.!?]{0,30}\b(except|with us|to confirm)",
        r"\b(kyc)\b[^.!?]{0,30}\b(pending|update|expire|incomplete|verification)\b",
        r"\b(scan (this|the) qr|qr code to (receive|get|claim))",
    )),
    ("reward", "social-engineering", 16, 5, 28, (
        r"\b(congratulations?|congrats|you'?ve been (selected|chosen)|you are (a )?(lucky )?winner|you have won|winner of)\b",
        r"\b(lottery|jackpot|lucky draw|prize|sweepstake|raffle|bonanza|scratch card|spin (the )?wheel)\b",
        r"\b(free|complimentary)\s+(gift|prize|iphone|laptop|voucher|coupon|recharge|data|cashback|reward|holiday|trip)\b",
        r"\b(claim|redeem|collect)\b[^.!?]{0,25}\b(your )?(prize|reward|gift|cashback|refund|bonus|points|voucher)\b",
        r"\b(gift card|amazon voucher|google play code|itunes card)\b",
        r"\b(cash ?prize|₹\s?\d{2,}[,\d]*\s*(lakh|crore)?|rs\.?\s?\d{2,}[,\d]*|\$\s?\d{3,})\b[^.!?]{0,30}\b(won|winning|prize|reward|jackpot|lucky draw)\b",
        r"\b(you are eligible|eligibility confirmed)\b[^.!?]{0,30}\b(refund|reward|loan|subsidy|scheme)\b",
    )),
    ("financial-fraud", "financial-fraud", 17, 5, 30, (
        r"\b(pay|transfer|deposit|remit|send)(?:s|ing)?\b[^.!?]{0,35}\b(fee|charge|amount|tax|duty|customs|processing|registration|security deposit|advance|penalty|fine|premium|dues|instal?ment|emi|challan|bill)\b",
        r"\b(pay|transfer|send)(?:s|ing)?\b[^.!?]{0,30}\b(again|now|immediately)?\b[^.!?]{0,25}\b(new|updated|different|below|following)\s+(upi\s*(id|address)?|account|vpa|number|beneficiary|qr)",
        r"\b(wire transfer|bank transfer|neft|rtgs|imps|swift)\b[^.!?]{0,40}\b(urgent|today|immediately|asap|confidential)",
        r"\b(change|update|new)\b[^.!?]{0,25}\b(bank (account|details)|account (number|details)|payment (details|instructions)|beneficiary)\b",
        r"\b(outstanding|pending|overdue|unpaid)\s+(invoice|payment|bill|dues|amount)\b",
        r"\b(bitcoin|btc|usdt|crypto|ethereum|binance|trust wallet|seed phrase|private key)\b",
        r"\b(gift ?cards?|google play|steam wallet)\b[^.!?]{0,30}\b(buy|purchase|send (me|us)|code)\b",
        r"\b(refund|reversal)\b[^.!?]{0,30}\b(processed|initiated|claim|pending)\b[^.!?]{0,40}\b(details|link|form|account)\b",
        r"\b(double your|guaranteed\s+(\d+\s*(%|percent)\s*)?(return|profit|income)|risk[-\s]?free\s+(investment|return|profit)|\d{2,}\s*(%|percent)\s*(monthly|weekly|daily|per month)?\s*(return|profit|income|interest))",
        r"\b(\d{2,}\s*(%|percent)\s*(return|profit)|assured returns|fixed daily (income|profit)|trading signals?)\b",
        r"\b(loan)\b[^.!?]{0,30}\b(approved|pre-?approved|instant|without documents|no cibil)\b",
    )),
    ("tech-support", "social-engineering", 15, 5, 26, (
        r"\b(call|contact|dial|whatsapp)\b[^.!?]{0,30}\b(support|helpline|customer care|toll[-\s]?free|technician|agent)\b",
        r"\b(microsoft|windows|apple|google)\s+(support|technician|security|help ?desk)\b",
        r"\b(install|download|run|sideload)(?:s|ed|ing)?\b[^.!?]{0,35}\b(anydesk|teamviewer|quicksupport|remote (access|desktop)|screen (share|sharing)|support tool)\b",
        r"\b(install|download|update)(?:s|ed|ing)?\b[^.!?]{0,40}\b(apk|\.apk|app from (the )?link|new (secure )?app|updated app|mobile app)\b",
        r"\b(your (computer|pc|device|phone) (is|has been) (infected|hacked|compromised|at risk))\b",
        r"\b(license|subscription|antivirus|warranty)\b[^.!?]{0,30}\b(expired|expiring|renew|auto[-\s]?renew(ed|al)?|charged)\b",
        r"\b(error code|virus alert|security alert)\s*[:#]?\s*[a-z0-9-]{3,}",
    )),
    ("job-scam", "social-engineering", 14, 4, 24, (
        r"\b(work from home|part[-\s]?time job|earn (₹|rs\.?|\$)?\s?\d[\d,]*\s*(per|/)\s*(day|hour|week|month))\b",
        r"\b(job|position|offer letter|placement|internship)\b[^.!?]{0,40}\b(selected|shortlisted|confirmed|no interview|without interview|direct joining)\b",
        r"\b(registration|security|training|processing)\s+(fee|charge|amount|deposit)\b",
        r"\b(daily payout|instant payment|easy (task|money)|just \d+ hours? (a|per) day)\b",
        r"\b(like|subscribe|review)\b[^.!?]{0,25}\b(task|videos?|products?|hotels?)\b[^.!?]{0,25}\b(earn|paid|commission|₹|rs\.?)",
        r"\b(send (your )?(resume|cv|documents|aadhaar|pan)\b[^.!?]{0,30}\b(whatsapp|telegram))",
    )),
    ("emotional", "social-engineering", 12, 4, 20, (
        r"\b(i (really )?(need|trust) (your help|your assistance|you to help|only you)|only you can help|please help me|i have no one else|you are my last hope)\b",
        r"\b(dying|hospital|surgery|accident|cancer|orphan|widow|refugee|earthquake|flood relief)\b[^.!?]{0,50}\b(donat|help|fund|money|transfer|support)\b",
        r"\b(my (dear|love|darling|honey)|god bless you|beloved (friend|one)|dearest one)\b",
        r"\b(inheritance|next of kin|unclaimed (funds|estate)|late (mr|mrs|dr)\.?\s+\w+)\b",
        r"\b(keep this (confidential|between us|a secret)|do not (tell|inform) (anyone|anybody)|strictly confidential)\b",
        r"\b(i am (stuck|stranded)|lost my (wallet|phone|passport))\b",
    )),
    ("link-lure", "content", 9, 3, 15, (
        r"\b(click|tap|press)\s+(here|the link|below|on the link|this link)\b",
        r"\b(follow|open|use)\s+(this|the)\s+(link|url|attachment)\b",
        r"\b(track (it|your (order|package|shipment)) here)\b",
        r"\b(login|log in|sign in|verify|update|claim|download|pay)\s*(?::|->|=>|➡|👉)\s*(?=https?://|www\.)",
        r"\b(link (below|above)|see (the )?attachment|view (document|invoice|statement))\b",
    )),
    ("impersonal", "content", 7, 2, 11, (
        r"\b(dear (customer|user|client|sir/madam|sir or madam|account holder|valued (customer|member)|member|friend|beneficiary|winner|applicant))\b",
        r"\b(attention:?\s*(customer|user|account holder))\b",
        r"\b(undisclosed[-\s]?recipients?|to whom it may concern)\b",
    )),
    ("channel-switch", "social-engineering", 11, 4, 18, (
        r"\b(contact|message|reach|ping|chat|dm)\b[^.!?]{0,25}\b(on\s+)?(whats\s?app|whatsapp|telegram|signal|wechat)\b",
        r"\b(wa\.me|t\.me|api\.whatsapp\.com|chat\.whatsapp\.com)\b",
        r"\b(reply (with|to this)|revert on)\b[^.!?]{0,20}\b(personal|private|alternate)\s+(number|email|id)\b",
        r"\b(do not (reply|respond) (to|on) (this )?(email|official))\b",
    )),
    ("secrecy", "social-engineering", 12, 4, 18, (
        r"\b(don'?t|do not)\s+(tell|inform|discuss|involve|contact)\b[^.!?]{0,30}\b(anyone|team|finance|accounts|manager|colleague|it)\b",
        r"\b(bypass|skip|ignore)\b[^.!?]{0,25}\b(process|procedure|approval|verification|policy)\b",
        r"\b(i'?m (in a meeting|travelling|on a flight|unavailable)|can'?t (talk|call) (right )?now)\b[^.!?]{0,60}\b(so|please|need you to)\b",
        r"\b(handle this (personally|discreetly|quietly)|strictly (confidential|between us))\b",
    )),
    ("bec", "bec", 18, 5, 28, (
        r"\b(are you (at your desk|available|free)\??)\b",
        r"\b(need (you|your help) (to|with))\b[^.!?]{0,40}\b(payment|transfer|invoice|vendor|wire|gift cards?|payroll|w-?2|employee (data|details))\b",
        r"\b(vendor|supplier|beneficiary|company|our|accounts?( department)?)\b[^.!?]{0,35}\b(bank|banks|account|payment)\b[^.!?]{0,30}\b(chang(e|ed|ing)|updat(e|ed)|switch(ed)?|new)\b",
        r"\b(bank|banking|account) details?\b[^.!?]{0,25}\b(have|has|was|were|are)?\s*(chang(e|ed)|updat(e|ed)|new)\b",
        r"\b(use|note)\s+(the\s+)?(new|updated|revised|attached)\s+(bank|account|beneficiary|payment)\s*(details?|instructions?)?",
        r"\b(process (this|the) (payment|invoice|transfer))\b[^.!?]{0,30}\b(today|urgently|immediately|before)\b",
        r"\b(sent from my (i|I)phone)\b[\s\S]{0,80}\b(payment|transfer|urgent)\b",
        r"\b(payroll|salary)\s+(details|account|update)\b",
    )),
    ("delivery-lure", "content", 10, 3, 16, (
        r"\b(package|parcel|shipment|consignment|courier|delivery)\b[^.!?]{0,40}\b(delayed|held|pending|failed|on hold|customs|address|reschedul|undelivered|attempt)\b",
        r"\b(customs (duty|clearance|fee)|shipping (fee|charge)|redelivery)\b",
        r"\b(tracking (number|id|code))\b[^.!?]{0,30}\b(click|link|update|confirm)\b",
        r"\b(confirm your (delivery )?address)\b",
    )),
    ("account-alert", "content", 10, 3, 16, (
        r"\b(we (noticed|detected|found)|there (was|has been))\b[^.!?]{0,40}\b(sign[-\s]?in|login|access|activity|transaction|attempt|device|location)\b",
        r"\b(new device|unknown device|new location|different (device|ip))\b[^.!?]{0,30}\b(sign|login|access)",
        r"\b(if this (wasn'?t|was not) you)\b",
        r"\b(password (was )?(changed|reset)|recovery (email|phone) (changed|added))\b",
        r"\b(review (this )?activity|secure your account (now|immediately))\b",
    )),
)
# fmt: on

# Category of a signal: cap of its sum, and its name.
CATEGORY_CAPS = {"url": 42, "domain": 40, "sender": 40, "credential-theft": 40, "financial-fraud": 34, "bec": 32, "social-engineering": 42, "page": 40, "content": 26, "intel": 65, "ml": 34, "ai": 40}
DEFAULT_CATEGORY_CAP = 30
KAPPA = 29
POSITIVE_CAP = 50
# (least evidence, factor) and (least weight, floor), tested in this order.
DAMPING = ((55, 0.25), (40, 0.5), (0, 1.0))
FLOORS = ((26, 72), (22, 60))
LOW, MEDIUM = 30, 70
# Feature groups: id, categories.
FEATURE_GROUPS = (("language", ("content",)), ("manipulation", ("social-engineering", "bec")), ("sender", ("sender", "domain")), ("url", ("url",)), ("credential", ("credential-theft", "financial-fraud")), ("website", ("page",)))
# The order in which categories give advice.
ADVICE_ORDER = ("credential-theft", "financial-fraud", "bec", "sender", "domain", "url", "page", "social-engineering", "content")
STRONG_TACTICS = ("credential-request", "financial-fraud", "reward", "fear", "bec", "tech-support", "job-scam")
CHANNELS = {"email": "email", "sms": "SMS message", "chat": "chat message", "whatsapp": "WhatsApp message", "social": "social media message", "url": "link", "website": "website", "message": "message"}
# Reputation: (least reports, weight), tested in this order.
REPORT_WEIGHTS = ((5, 30), (2, 22), (1, 12))
BLOCKLIST_WEIGHT = 45

OFFICIAL_DOMAINS = tuple(dict.fromkeys(d for _, _, ds in BRANDS for d in ds))
TRUSTED_DOMAINS = tuple(dict.fromkeys((*OFFICIAL_DOMAINS, *OTHER_TRUSTED_DOMAINS)))
