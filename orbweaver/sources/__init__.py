"""orbweaver.sources"""
