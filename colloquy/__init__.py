"""Conversation analytics on Spark: dialogues, phrase dictionaries, retrieval and text preparation."""
