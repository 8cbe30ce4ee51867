"""Reading and writing with codecs."""
