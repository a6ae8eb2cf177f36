"""Operators of a training-data pipeline: quality, secrets, personal data, duplicates, mixing, pages,
chats and tokens. Nothing outside this folder imports it."""
