"""orbweaver.streaming"""
