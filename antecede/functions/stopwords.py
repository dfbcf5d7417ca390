"""Common English function words for the token table."""

# Lower-case words flagged as stop words by default.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her him his i if in into is it "
    "its me my no not of on or our she so that the their them they this to was we were which "
    "who will with you your"
).split()
