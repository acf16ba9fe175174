"""Training-data operators: packing, language, chat format, toxicity, licences, contamination,
near copies, shards, quality and token counts.  Nothing else in the library imports this."""
