"""orbweaver.plans"""
