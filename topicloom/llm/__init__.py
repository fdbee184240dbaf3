"""Training-data operators: near-dedup, decontamination, mixing, media, quality, tokens, LM, chat, shards, licences."""
