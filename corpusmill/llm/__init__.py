"""Training-data operators: media, licences, toxicity, URL lists, near duplicates, mixing, tokens, chats, WARC."""
