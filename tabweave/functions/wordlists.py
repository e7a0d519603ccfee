"""Fixed word lists and marks that results depend on."""

from __future__ import annotations

# Words counted for the stop-word ratio.
COMMON_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")

# Sentiment words.
POSITIVE_WORDS = (
    "good", "great", "excellent", "amazing", "wonderful", "fantastic",
    "perfect", "love", "best", "beautiful", "happy", "nice", "awesome",
)
NEGATIVE_WORDS = (
    "bad", "terrible", "awful", "horrible", "worst", "hate",
    "dislike", "angry", "sad", "poor", "wrong", "stupid",
)

# Marks counted as special characters, and emoticons.
SPECIAL_MARKS = "!@#$%^&*()_+-=[]{}|;:,.<>?/~`"
EMOTICONS = (":)", ":(", ";)", ":D", ":/", ":P", ":|", ":*")

# Spark's default English stop words that can be a token of two or more letters.
ENGLISH_STOP_WORDS = (
    "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "can", "will", "just", "don", "should", "now", "cannot", "could", "ought",
    "would",
)
