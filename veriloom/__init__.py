"""A PySpark engine that verifies messages, pages, posts and chats, and prepares text corpora."""
